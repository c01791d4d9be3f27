"""Generators that are called: bounded, repeated, and kept, against a server of the tests."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from florilege.plans.answer import Called, Extractive, Remembered, remote


class Server(BaseHTTPRequestHandler):
    """Answers with the question; those with "fails" in them always fail, those with "twice" only twice, those with "slow" late."""

    seen: list = []
    lock, now, most = threading.Lock(), 0, 0

    def do_POST(self):
        cls = type(self)
        body = json.loads(self.rfile.read(int(self.headers["content-length"])))
        asked = body["messages"][0]["content"].rpartition("Question: ")[2]
        with cls.lock:
            cls.now += 1
            cls.most = max(cls.most, cls.now)
            cls.seen.append((asked, self.headers.get("service-version"), self.headers["x-api-key"]))
            times = sum(a == asked for a, *_ in cls.seen)
        time.sleep(0.3 if "slow" in asked else 0.01)
        failed = "fails" in asked or ("twice" in asked and times <= 2)
        reply = {"error": {"message": "overloaded"}} if failed else {"content": [{"type": "text", "text": f"re: {asked}"}]}
        with cls.lock:
            cls.now -= 1
        self.send_response(529 if failed else 200)
        self.end_headers()
        self.wfile.write(json.dumps(reply).encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    Server.seen, Server.now, Server.most = [], 0, 0
    http = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}/"
    http.shutdown()


def asked(spark, *questions):
    rows = [(k, q, [("p.txt", "passage")]) for k, q in enumerate(questions)]
    return spark.createDataFrame(rows, "query_id long, question string, passages array<struct<path:string,text:string>>").coalesce(1)


def answers(frame):
    return {r.question: (r.text, r.error) for r in frame.collect()}


def test_failures_are_rows_and_calls_are_repeated(spark, server):
    g = remote(server, "key", "m", headers={"service-version": "7"}, attempts=3, pause=0.05)
    got = answers(g.answer(asked(spark, "plain", "works at the third, not twice", "fails")))
    assert got == {"plain": ("re: plain", None), "works at the third, not twice": ("re: works at the third, not twice", None), "fails": ("", "RuntimeError: overloaded")}
    assert sorted(q for q, *_ in Server.seen) == ["fails"] * 3 + ["plain"] + ["works at the third, not twice"] * 3
    assert {(v, k) for _, v, k in Server.seen} == {("7", "key")}


def test_calls_run_beside_each_other_but_no_more_than_allowed(spark, server):
    questions = [f"slow {k}" for k in range(12)]
    began = time.monotonic()
    got = answers(remote(server, "key", "m", workers=4, per_second=1000).answer(asked(spark, *questions)))
    assert len(got) == 12 and all(e is None for _, e in got.values())
    assert 2 <= Server.most <= 4 and time.monotonic() - began < 12 * 0.3 + 30


def test_a_budget_of_calls(spark):
    frame = Called(lambda q, p: str(time.monotonic()), per_second=10).answer(asked(spark, *"abcdef"))
    times = sorted(float(t) for t, _ in answers(frame).values())
    assert all(b - a > 0.08 for a, b in zip(times, times[1:]))


def test_answers_are_kept(spark, server, tmp_path):
    g = Remembered(remote(server, "key", "m", attempts=1), str(tmp_path / "kept"))
    rows = asked(spark, "one", "two", "one", "fails")
    want = {"one": ("re: one", None), "two": ("re: two", None), "fails": ("", "RuntimeError: overloaded")}
    found = g.answer(rows)
    assert answers(found) == want and found.count() == 4
    assert sorted(q for q, *_ in Server.seen) == ["fails", "one", "two"]  # a prompt is sent once, and answers are read from the table
    assert answers(g.answer(asked(spark, "two", "three", "fails"))) == {"two": want["two"], "three": ("re: three", None), "fails": want["fails"]}
    assert sorted(q for q, *_ in Server.seen) == ["fails", "fails", "one", "three", "two"]
    other = rows.withColumn("passages", F.expr("transform(passages, p -> struct(p.path, 'another' as text))"))
    g.answer(other.where("question = 'two'")).collect()
    assert sum(q == "two" for q, *_ in Server.seen) == 2  # other passages make another prompt
    local = Remembered(Extractive(), str(tmp_path / "local"))
    assert {r.question: r.text for r in local.answer(rows).collect()} == {r.question: r.text for r in Extractive().answer(rows).collect()}
