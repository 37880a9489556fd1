"""Dict-in, dict-out service: the JSON API's routes without a web framework.

handle(method, path, body) gives (status, payload); request models are dataclasses with the defaults of the API.
"""

from __future__ import annotations

import os
import tempfile
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from lexforge.functions.text import analyze, summary
from lexforge.operators.terms import extract
from lexforge.pipeline import run_pipeline
from lexforge.sources import lookup as lk
from lexforge.sources.base import known
from lexforge.sources.store import Termbase, list_termbases


@dataclass
class TextRequest:
    text: str = ""
    top_n: int = 30


@dataclass
class SearchRequest:
    term: str = ""
    limit: int = 20


@dataclass
class TermAddRequest:
    word: str = ""
    translation: str = ""
    domain: str = ""
    type: str = ""
    lang: str = "auto"
    status: str = "draft"
    notes: str = ""
    db: str = "terms"


@dataclass
class TermSearchRequest:
    query: str = ""
    db: str = "terms"
    limit: int = 20


@dataclass
class BaseInitRequest:
    name: str = ""
    domain: str = ""


@dataclass
class PipelineRequest:
    text: str = ""
    project_name: str = "Untitled"
    top_n: int = 20
    formats: list[str] = field(default_factory=list)


class Refused(Exception):
    def __init__(self, status: int, detail: str):
        super().__init__(detail)
        self.status = status


def _need(value: str, what: str) -> str:
    if not value.strip():
        raise Refused(400, f"{what} is required")
    return value


class Service:
    def __init__(self, spark: SparkSession, root: str, fetch: lk.Fetcher | None = None):
        self.spark, self.root, self.fetch = spark, root, fetch
        self.routes = {
            ("GET", "/api/sources"): self.sources, ("POST", "/api/analyze"): self.analyze, ("POST", "/api/extract"): self.extract, ("POST", "/api/search"): self.search,
            ("POST", "/api/term/add"): self.term_add, ("POST", "/api/term/search"): self.term_search, ("GET", "/api/db/list"): self.db_list,
            ("GET", "/api/db/info"): self.db_info, ("POST", "/api/db/init"): self.db_init, ("POST", "/api/pipeline"): self.pipeline,
        }

    def handle(self, method: str, path: str, body: dict | None = None) -> tuple[int, dict]:
        route = self.routes.get((method, path))
        if route is None:
            return 404, {"detail": "not found"}
        try:
            return 200, route(body or {})
        except Refused as e:
            return e.status, {"detail": str(e)}
        except FileNotFoundError as e:
            return 404, {"detail": str(e)}
        except TypeError as e:  # a field that the request doesn't have
            return 422, {"detail": str(e)}

    def _docs(self, text: str):
        return self.spark.createDataFrame([("text", text)], "doc_id string, text string")

    def sources(self, _: dict) -> dict:
        return {"sources": [{"name": s.name, "available": s.available} for s in known()]}

    def analyze(self, body: dict) -> dict:
        row = analyze(self._docs(_need(TextRequest(**body).text, "text"))).drop("text", "doc_id").head()
        return row.asDict() | {"domain_scores": {k: round(v, 3) for k, v in row["domain_scores"].items()}, "summary": summary(row)}

    def extract(self, body: dict) -> dict:
        r = TextRequest(**body)
        rows = extract(self._docs(_need(r.text, "text")), r.top_n).orderBy("rank").collect()
        return {"terms": [{"term": x["term"], "frequency": x["frequency"], "score": round(x["score"], 3), "type": x["word_type"]} for x in rows]}

    def search(self, body: dict) -> dict:
        r = SearchRequest(**body)
        asked = self.spark.createDataFrame([(_need(r.term, "term"),)], "query string")
        rows = lk.federate(None, lk.lookup(asked, self.fetch, r.limit), r.limit).orderBy("place").collect()
        return {"results": [{k: x[k] for k in ("query", "word", "type", "source", "score", "definition")} for x in rows]}

    def term_add(self, body: dict) -> dict:
        r = TermAddRequest(**body)
        base = Termbase.open_or_create(self.spark, self.root, r.db)
        return {"id": base.add_term(_need(r.word, "word"), r.lang, r.type, r.translation, r.domain, r.status, r.notes)}

    def term_search(self, body: dict) -> dict:
        from lexforge.operators.termbase import search_terms

        r = TermSearchRequest(**body)
        return {"results": [x.asDict() for x in search_terms(Termbase(self.spark, self.root, r.db).terms, _need(r.query, "query"), r.limit).collect()]}

    def db_list(self, _: dict) -> dict:
        return {"termbases": list_termbases(self.spark, self.root)}

    def db_info(self, body: dict) -> dict:
        return Termbase(self.spark, self.root, body.get("db", "terms")).stats()

    def db_init(self, body: dict) -> dict:
        r = BaseInitRequest(**body)
        try:
            Termbase.create(self.spark, self.root, _need(r.name, "name"), r.domain)
        except FileExistsError as e:
            raise Refused(409, str(e)) from e
        return {"name": r.name, "domain": r.domain}

    def pipeline(self, body: dict) -> dict:
        r = PipelineRequest(**body)
        _need(r.text, "text")
        with tempfile.TemporaryDirectory() as d:
            report = os.path.join(d, "report.md")
            got = run_pipeline(self.spark, self.root, text=r.text, project_name=r.project_name, top_n=r.top_n, report_output=report, export_formats=r.formats, fetch=self.fetch)
            body_text = open(report, encoding="utf-8").read() if got.report_path else ""  # noqa: SIM115
        terms = [{"term": t["term"], "frequency": t["frequency"], "score": round(t["score"], 3), "type": t["word_type"]} for t in got.terms]
        return {"project": got.project_name, "analysis": got.analysis, "terms": terms, "termbase": got.termbase_name, "terms_added": got.termbase_terms, "report": body_text, "exports": got.exports, "errors": got.errors, "duration": round(got.duration, 1)}
