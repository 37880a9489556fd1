"""Command line: python -m lexforge COMMAND."""

from __future__ import annotations

import argparse
import csv
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexforge.functions.text import analyze, read_documents, summary
from lexforge.operators import export as exports
from lexforge.operators.report import generate_report, save_report
from lexforge.operators.termbase import search_terms
from lexforge.operators.terms import extract, frequency_table
from lexforge.pipeline import format_pipeline_result, run_pipeline
from lexforge.service import Service
from lexforge.sources import lookup as lk
from lexforge.sources.base import known
from lexforge.sources.store import Termbase, delete_termbase, list_termbases
from lexforge.web import server


def load_env(path: str = ".env") -> None:
    """KEY=VALUE lines of a file into the environment, where not set yet."""
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                key, sep, value = line.strip().partition("=")
                if sep and not key.startswith("#"):
                    os.environ.setdefault(key.strip(), value.strip().strip("\"'"))


def _search(spark: SparkSession, root: str, terms: list[str], source: str, limit: int, cache: str = ""):
    """Ranked rows of every term; a missing termbase has no local results."""
    asked = spark.createDataFrame([(t,) for t in dict.fromkeys(terms)], "query string")
    local = None
    if source in ("local", "all"):
        try:
            base = Termbase(spark, root)
            local = lk.local_results_many(base.terms, base.associations, asked, limit)
        except FileNotFoundError:
            local = None
    web = lk.lookup(asked, lk.http_fetch, limit, cache or None) if source in ("web", "all") else None
    if local is None and web is None:
        return []
    return lk.federate(local, web, limit).orderBy("query", "place").collect()


def _print_rows(rows) -> None:
    for r in rows:
        print(f"{r['word']}\t{r['type']}\t{r['source']}\t{r['score']}\t{r['definition'] or ''}")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexforge", description="Terminology preparation for translation projects")
    p.add_argument("--root", default="termbases", help="folder of the termbases")
    sub = p.add_subparsers(dest="command", required=True)

    def command(at, name: str, *args: tuple, **kw) -> argparse.ArgumentParser:
        c = at.add_parser(name, **kw)
        for a in args:
            c.add_argument(*a[0].split("|"), **(a[1] if len(a) > 1 else {}))
        return c

    db_opt, limit = ("--db", {"default": "terms"}), ("--limit", {"type": int, "default": 20})
    cache = ("--cache", {"default": "", "help": "folder of kept responses"})
    command(sub, "search", ("term",), ("--source", {"choices": ["local", "web", "all"], "default": "all"}), limit, cache)
    command(sub, "batch", ("input",), ("--output|-o", {"default": ""}), ("--source", {"choices": ["local", "web", "all"], "default": "all"}), limit, cache)
    command(sub, "analyze", ("file",))
    command(sub, "extract", ("file",), ("--top", {"type": int, "default": 30}), ("--strategy", {"default": "bigram"}))
    command(sub, "report", ("file",), ("--name", {"default": "Untitled Project"}), ("--output|-o", {"default": ""}), ("--db", {"default": ""}), ("--notes", {"default": ""}), ("--top", {"type": int, "default": 30}))
    command(sub, "sources")
    command(sub, "pipeline", ("file",), ("--name", {"default": "Untitled"}), ("--top", {"type": int, "default": 20}), ("--search-limit", {"type": int, "default": 5}), ("--db", {"default": ""}), ("--report|-r", {"default": ""}), ("--formats|-f", {"default": ""}), ("--notes", {"default": ""}), ("--lookup", {"action": "store_true"}))
    command(sub, "web", ("--host", {"default": "127.0.0.1"}), ("--port", {"type": int, "default": 8000}), ("--lookup", {"action": "store_true"}))
    db = sub.add_parser("db").add_subparsers(dest="action", required=True)
    command(db, "list")
    command(db, "init", ("name",), ("--domain", {"default": ""}))
    command(db, "info", db_opt)
    command(db, "delete", ("name",))
    command(db, "merge", ("source",), db_opt, ("--no-dedup", {"action": "store_true"}))
    command(db, "import", ("file",), db_opt, ("--no-dedup", {"action": "store_true"}))
    command(db, "export", ("output",), db_opt, ("--format", {"default": "csv"}), ("--status", {"default": ""}))
    term = sub.add_parser("term").add_subparsers(dest="action", required=True)
    fields = [(f"--{c}", {"default": None}) for c in ("translation", "domain", "type", "lang", "status", "notes")]
    command(term, "add", ("word",), *fields, db_opt)
    command(term, "delete", ("id", {"type": int}), db_opt)
    command(term, "update", ("id", {"type": int}), ("--word", {"default": None}), *fields, db_opt)
    command(term, "search", ("query",), db_opt, limit)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    load_env()
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lexforge").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return _run(a, spark)
    except (FileNotFoundError, FileExistsError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def _run(a: argparse.Namespace, spark: SparkSession) -> int:
    root = a.root
    what = a.command if a.command not in ("db", "term") else f"{a.command} {a.action}"
    if what == "search":
        _print_rows(_search(spark, root, [a.term], a.source, a.limit, a.cache))
    elif what == "batch":
        lines = [r["t"] for r in spark.read.text(a.input).select(F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("t")).filter("t <> ''").toLocalIterator()]
        rows = _search(spark, root, lines, a.source, a.limit, a.cache)
        by: dict = {}
        for r in rows:
            by.setdefault(r["query"], []).append(r)
        out = open(a.output, "w", encoding="utf-8", newline="") if a.output else sys.stdout  # noqa: SIM115
        w = csv.writer(out)
        w.writerow(["query", "word", "type", "source", "score"])
        w.writerows([r["query"], r["word"], r["type"], r["source"], r["score"]] for t in lines for r in by.get(t, []))
        if a.output:
            out.close()
    elif what == "analyze":
        print(summary(analyze(read_documents(spark, a.file)).head()))
    elif what == "extract":
        print(frequency_table(extract(read_documents(spark, a.file), a.top, a.strategy).orderBy("rank").collect()))
    elif what == "report":
        docs = read_documents(spark, a.file)
        stats = Termbase(spark, root, a.db).stats() if a.db else None
        terms = [r.asDict() for r in extract(docs, a.top).orderBy("rank").collect()]
        text = generate_report(analyze(docs).drop("text").head().asDict(), terms, stats, a.name, a.file, a.notes)
        if a.output:
            save_report(text, a.output)
        else:
            print(text[:2000])
    elif what == "sources":
        for s in known():
            print(f"{s.name}\t{'available' if s.available else 'not configured'}")
    elif what == "pipeline":
        formats = [f.strip() for f in a.formats.split(",") if f.strip()]
        print(format_pipeline_result(run_pipeline(spark, root, a.file, None, a.name, a.top, a.search_limit, a.db or None, a.report, formats, a.notes, fetch=lk.http_fetch if a.lookup else None)))
    elif what == "web":
        with server(Service(spark, root, lk.http_fetch if a.lookup else None), a.host, a.port) as http:
            print(f"http://{a.host}:{http.server_address[1]}")
            try:
                http.serve_forever()
            except KeyboardInterrupt:
                pass
    elif what == "db list":
        for b in list_termbases(spark, root):
            print(f"{b['name']}\t{b['domain']}\t{b['lang']}\t{b['total_terms']}")
    elif what == "db init":
        Termbase.create(spark, root, a.name, a.domain)
    elif what == "db info":
        s = Termbase(spark, root, a.db).stats()
        for k, v in s.items():
            print(f"{k}: {v if k != 'recent' else [r['word'] for r in v[:5]]}")
    elif what == "db delete":
        delete_termbase(spark, root, a.name)
    elif what == "db merge":
        print(Termbase(spark, root, a.db).merge(Termbase(spark, root, a.source), not a.no_dedup))
    elif what == "db import":
        print(Termbase.open_or_create(spark, root, a.db).import_csv(a.file, not a.no_dedup))
    elif what == "db export":
        print(exports.export(Termbase(spark, root, a.db), a.format, a.output, a.status or None))
    elif what == "term add":
        given = {("type_" if k == "type" else k): v for k in ("translation", "domain", "type", "lang", "status", "notes") if (v := getattr(a, k)) is not None}
        print(Termbase.open_or_create(spark, root, a.db).add_term(a.word, **given))
    elif what == "term delete":
        Termbase(spark, root, a.db).delete_term(a.id)
    elif what == "term update":
        Termbase(spark, root, a.db).update_term(a.id, **{k: v for k in ("word", "translation", "domain", "type", "lang", "status", "notes") if (v := getattr(a, k)) is not None})
    elif what == "term search":
        for r in search_terms(Termbase(spark, root, a.db).terms, a.query, a.limit).collect():
            print(f"{r['id']}\t{r['word']}\t{r['translation']}\t{r['domain']}\t{r['status']}")
    return 0
