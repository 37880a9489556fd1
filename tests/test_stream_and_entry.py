"""Streams reuse the batch operators; the driver's entry stands without the optional subpackage."""

import os
import subprocess
import sys

from lexforge.streaming.documents import analyze_stream, read_document_stream, term_counts

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("server server 数据", encoding="utf-8")
    for build, name, mode in ((analyze_stream, "profiles", "append"), (term_counts, "counts", "complete")):
        q = build(read_document_stream(spark, str(src))).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("profiles").head()["lang"] == "en"
    assert {r["token"]: r["n"] for r in spark.table("counts").collect()} == {"server": 2, "数据": 1}


def test_entry_without_the_optional_part():
    code = "import sys\nsys.modules['lexforge.llm'] = None\nsys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nq = e.queries()\nassert 'analyze_documents' in q and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
