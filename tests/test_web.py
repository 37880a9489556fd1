"""The API over HTTP."""

import json
import threading
import urllib.error
import urllib.request

import pytest

from lexforge import cli
from lexforge.service import Service
from lexforge.web import server


@pytest.fixture
def url(spark, tmp_path):
    with server(Service(spark, f"file://{tmp_path}/bases"), port=0) as http:
        threading.Thread(target=http.serve_forever, daemon=True).start()
        yield f"http://127.0.0.1:{http.server_address[1]}"
        http.shutdown()


def ask(url, body=None):
    data = None if body is None else body if isinstance(body, bytes) else json.dumps(body).encode()
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data)) as r:  # noqa: S310
            return r.status, json.load(r)
    except urllib.error.HTTPError as e:
        return e.code, json.load(e)


def test_requests(url):
    assert ask(f"{url}/api/db/init", {"name": "b", "domain": "it"}) == (200, {"name": "b", "domain": "it"})
    assert ask(f"{url}/api/db/init", {"name": "b"})[0] == 409
    assert ask(f"{url}/api/term/add", {"word": "合同", "db": "b"}) == (200, {"id": 1})
    assert ask(f"{url}/api/db/info?db=b")[1]["total_terms"] == 1
    status, found = ask(f"{url}/api/term/search", {"query": "合", "db": "b"})
    assert status == 200 and found["results"][0]["word"] == "合同"
    assert ask(f"{url}/api/analyze", {"text": "The server."})[1]["domain"] == "it"
    assert ask(f"{url}/api/analyze", {"text": " "})[0] == 400 and ask(f"{url}/api/analyze", {"nothing": 1})[0] == 422
    assert ask(f"{url}/api/analyze", b"{")[0] == 400 and ask(f"{url}/api/analyze", b"[]")[0] == 400
    assert ask(f"{url}/nothing")[0] == 404 and ask(f"{url}/api/db/info?db=none")[0] == 404


def test_requests_side_by_side(url):
    ask(f"{url}/api/db/init", {"name": "b"})
    got = []
    threads = [threading.Thread(target=lambda k=k: got.append(ask(f"{url}/api/term/add", {"word": f"w{k}", "db": "b"})[1]["id"])) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got) == [1, 2, 3, 4] and ask(f"{url}/api/db/info?db=b")[1]["total_terms"] == 4


def test_command():
    a = cli.parser().parse_args(["web", "--port", "0"])
    assert (a.command, a.host, a.port, a.lookup) == ("web", "127.0.0.1", 0, False)
