import datetime as dt
import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import losses as L
from lattica.functions import scalar as S
from lattica.functions.embedders import Hashing, Http, Zero, embedded, request_totals, shortened
from lattica.functions.siphash import siphash13
from lattica.operators import split as B


def test_siphash_vectors():
    got = siphash13(np.array([0, 0, 1, 3]), np.array([0, 1, 0, 4242]), np.array([123]))
    assert got.tolist() == [4804369940589001142, 13119263378503494471, 13472856163611868459, 6127488346781266790]


def test_split_counts():
    b = siphash13(np.zeros(15000), np.arange(15000), np.array([123])) % np.uint64(1000)
    train, val = B.bounds()
    assert ((b < train).sum(), ((b >= train) & (b < val)).sum(), (b >= val).sum()) == (11994, 1507, 1499)
    assert train == 800.0 and 900.0 < val < 900.001


def test_time_vector(spark):
    times = [dt.datetime(1969, 12, 31, 23, 59, 59), dt.datetime(2024, 2, 29), dt.datetime(2024, 12, 31), dt.datetime(2024, 1, 1), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t timestamp_ntz")
    got = {r.i: r for r in df.select("i", S.time_vector(F.col("t"), 0.0, 1e6).alias("v"), S.micros(F.col("t")).alias("us"), F.array(*S.time_parts(F.col("t"))).alias("p")).collect()}
    assert got[0].us == -1_000_000 and got[0].v[14] == pytest.approx(-1)
    assert got[1].p == [0, 0, 0, 3, 28, 1, 59] and got[2].p[6] == 365 and got[3].p[3] == 0
    assert got[4].v is None and all(len(got[i].v) == 15 for i in range(4))
    assert got[3].v[:2] == [0.0, 1.0]


@pytest.mark.parametrize("text", ["", "a" * 2047 + "é", "a" * 2046 + "é", "a" * 2045 + "€b", "a" * 2046 + "€", "a" * 2047 + "€", "a" * 2045 + "😀", "a" * 2047 + "😀" + "é" * 9, "é" * 1024, "é" * 1025, "b" * 3000])
def test_truncation(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(S.truncated(F.col("t"))).first()[0]
    assert got == text.encode()[:2048].decode(errors="ignore")


def test_casts(spark):
    df = spark.createDataFrame([("1.5", "x", None, "true")], "a string, b string, c string, d string")
    r = df.select(S.as_double(F.col("a")), S.as_long(F.col("a")), S.as_double(F.col("b")), S.as_double(F.col("c")), S.as_boolean(F.col("d")), S.as_time(F.col("b"))).first()
    assert tuple(r) == (1.5, None, None, None, True, None)


def test_zscore(spark):
    r = spark.createDataFrame([(3.0, None)], "a double, b double").select(S.zscore(F.col("a"), 1.0, 2.0), S.zscore(F.col("a"), 1.0, 0.0), S.zscore(F.col("b"), 1.0, 2.0)).first()
    assert tuple(r) == (1.0, 0.0, None)


def test_losses(spark):
    r = spark.createDataFrame([(0,)], "a int").select(L.bce(F.lit(50.0), F.lit(0.0)), L.bce(F.lit(-800.0), F.lit(0.0)), L.huber(F.lit(0.5)), L.huber(F.lit(-3.0)), L.category_loss(F.array(F.lit(0.0), F.lit(0.0)), F.lit(7))).first()
    assert r[0] == pytest.approx(50) and r[1] == pytest.approx(0) and r[2] == 0.125 and r[3] == 2.5
    assert r[4] == pytest.approx(np.log(2) + 1e-4 * np.log(2) ** 2)


def test_cell_loss_picks_the_type(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 2.0, 0.0, 0.0, 1.0), (3, 0, 0.0, 9.0, 0.0, 0.0, 1.0), (1, 1, 0.0, 9.0, 0.0, 0.0, 1.0)], "target_stype int, is_null int, null_logit double, num_pred double, num_true double, bool_logit double, bool_true double")
    got = [r[0] for r in df.select(L.cell_loss(df)).collect()]
    assert got == pytest.approx([np.log(2) + 1.5, 2 * np.log(2), np.log(2)])


def test_embedders(spark):
    x = Hashing().embed(["alpha beta", "alpha beta", "gamma", ""])
    assert x.shape == (4, 256) and np.allclose(np.linalg.norm(x, axis=1), 1) and np.array_equal(x[0], x[1]) and x[0] @ x[2] < 0.99
    assert not Zero().embed(["a"]).any() and not shortened(np.zeros((1, 8), np.float32), 4).any()
    got = embedded(spark.createDataFrame([(i, str(i)) for i in range(300)], "i int, text string").coalesce(1), Hashing(16)).collect()
    assert [r.i for r in got] == list(range(300)) and all(len(r.emb) == 16 for r in got)


def test_served_embeddings(spark):
    lock, state = threading.Lock(), {"calls": 0, "now": 0, "most": 0}

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
            with lock:
                state["calls"] += 1
                state["now"] += 1
                state["most"] = max(state["most"], state["now"])
                fails = state["calls"] % 7 == 1
            time.sleep(0.1)
            # vectors come in any order, with their place
            body = json.dumps({"data": [{"index": i, "embedding": [3.0, float(len(t)), 9.0]} for i, t in reversed(list(enumerate(texts)))]}).encode()
            with lock:
                state["now"] -= 1
            self.send_response(500 if fails else 200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        totals, url = request_totals(spark), f"http://127.0.0.1:{server.server_address[1]}/"
        texts = [(i, None if i == 5 else "x" * (i % 11)) for i in range(200)]
        df = spark.createDataFrame(texts, "i int, text string").coalesce(1)
        got = embedded(df, Http(url, dimension=2, served=3, batch=10, at_once=8), totals=totals).collect()
        assert [r.i for r in got] == list(range(200))
        for r, (_, t) in zip(got, texts, strict=True):
            want = np.array([3.0, len(t or "")])
            assert r.emb == pytest.approx(want / np.linalg.norm(want), abs=1e-3)
        assert 1 < state["most"] <= 8 and state["calls"] > 20
        assert totals.value[0] == 20 and totals.value[2] >= 20 * 100_000
    finally:
        server.shutdown()


def test_bits():
    raw = S.packed_bits([True, False, True] + [False] * 62 + [True])
    assert len(raw) == 16 and S.bit(raw, 0) and not S.bit(raw, 1) and S.bit(raw, 2) and S.bit(raw, 65)
