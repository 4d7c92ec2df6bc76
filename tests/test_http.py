"""Requests to a server on this machine."""

import http.server
import threading
import time
from collections import Counter

import pytest

from bibspark.operators import enrich
from bibspark.sources import bib, http as over_http

ASKED: Counter = Counter()


class Handler(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        ASKED[self.path] += 1
        code, name = 200, self.path.strip("/")
        if name.startswith("code"):
            code = int(name[4:7])
        if name.startswith("slow"):
            time.sleep(3)
        if name.startswith("drip"):  # bytes come, but never end in time
            self.send_response(200)
            self.end_headers()
            try:
                for _ in range(40):
                    self.wfile.write(b"x")
                    self.wfile.flush()
                    time.sleep(0.1)
            except OSError:
                pass
            return
        body = f'{{"title":"T {name} \u00e9 {self.headers["User-Agent"]}"}}'.encode()
        self.send_response(code)
        if code in (301, 302):
            self.send_header("Location", f"/to{name[7:]}")
        self.end_headers()
        try:
            self.wfile.write(body)
        except OSError:
            pass

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def server():
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_get(server):
    status, body = over_http.get(f"{server}/a")
    assert status == 200 and body == f'{{"title":"T a \u00e9 {over_http.AGENT}"}}'
    assert over_http.get(f"{server}/code302b")[1].startswith('{"title":"T tob')
    assert [over_http.get(f"{server}/code{c}") for c in (404, 429, 500)] == [(404, None), (429, None), (500, None)]
    for url in (f"{server}/slow", f"{server}/drip"):
        began = time.monotonic()
        assert over_http.get(url, timeout=1) == (0, None) and time.monotonic() - began < 2.5
    assert over_http.get("http://127.0.0.1:1/") == over_http.get("no url") == over_http.get("http://[bad") == (0, None)


def requests(server):
    names = ["a", "b", "code404", "code429", "code500", "code301c", "slow", *[f"n{i}" for i in range(30)]]
    return [("OpenAlex", "doi", n, f"{server}/{n}") for n in names]


def test_snapshot_equals_fetch_and_the_data_source(spark, server):
    rows = requests(server)
    df = spark.createDataFrame([*rows, rows[0], ("OpenAlex", "doi", "none", None)], "source string, lookup_kind string, lookup_key string, url string")
    ASKED.clear()
    snap = over_http.snapshot(df, tasks=4, pause=0.01, timeout=1)
    told = sorted(map(tuple, snap.collect()))
    assert {r[2] for r in told} == {r[2] for r in rows} - {"code404", "code429", "code500", "slow"} and all(r[3] == 200 for r in told)
    snap.count()
    assert set(ASKED.values()) == {1}  # reading the snapshot asks nothing
    by_hand = bib.fetch(df.where("url IS NOT NULL").distinct(), over_http.Polite(0, 1)).where("status = 200")
    assert sorted(map(tuple, by_hand.collect())) == told
    source = over_http.ask(spark, rows, partitions=5, pause=0, timeout=1)
    assert source.rdd.getNumPartitions() == 5 and sorted(map(tuple, source.collect())) == told
    assert over_http.ask(spark, []).count() == 0
    assert {r["lookup_key"]: r["candidate"]["title"] for r in enrich.candidates(snap).collect()}["b"] == f"T b \u00e9 {over_http.AGENT}"


def test_pauses(server):
    began = time.monotonic()
    ask = over_http.Polite()
    assert [ask(f"{server}/p{i}")[0] for i in range(4)] == [200] * 4
    assert time.monotonic() - began >= 4 * over_http.PAUSE
