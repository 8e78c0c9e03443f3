import json
import math
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from spanlens.operators import judge
from spanlens.sources import model


class Stub:
    """A server that answers by a script: prompts it saw, and what it says to the next calls before it answers well."""

    def __init__(self):
        self.seen, self.script, self.lock = [], [], threading.Lock()
        stub = self

        class Handler(BaseHTTPRequestHandler):
            protocol_version = "HTTP/1.1"

            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                with stub.lock:
                    stub.seen.append((self.path, self.headers.get("Authorization"), body))
                    status, data = stub.script.pop(0) if stub.script else (200, stub.answer(self.path, body))
                self.send_response(status)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_address[1]}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    @staticmethod
    def answer(path, body):
        prompt = body["messages"][1]["content"] if "messages" in body else body["prompt"]
        lines = prompt.split("What is")[-1].splitlines()
        letter = next((x[0] for x in lines if ") " in x[:3] and "record" in x), "A")
        top = [{"token": letter, "logprob": math.log(0.9)}, {"token": " B", "logprob": math.log(0.05)}]
        return json.dumps({"choices": [{"logprobs": {"content": [{"top_logprobs": top}]}}]} if "messages" in body else {"logprobs": [{"top_logprobs": top}]}).encode()


@pytest.fixture
def stub():
    s = Stub()
    yield s
    s.server.shutdown()


@pytest.fixture
def shown(spark):
    """Questions about two spans, of which two candidates ask the same, in every order of their options."""
    text = "ref 7734-2210-9 noted, S1234567D"
    asked = spark.createDataFrame([(1, text, 5, 15), (2, text, 5, 15), (3, text, 24, 32)], "candidate int, text string, span_start int, span_end int")
    asked = asked.select("*", F.expr("substring(text, span_start, span_end - span_start + 1)").alias("match"), F.lit("code").alias("family"), F.lit(None).cast("string").alias("column"), F.lit("choice").alias("kind"))
    return judge.order_rows(asked)


def told(shown, backend):
    return {(r.candidate, r.order_idx, r.token): round(r.prob, 4) for r in backend(shown).collect()}


@pytest.mark.parametrize("chat", [True, False])
def test_answers_come_from_the_server_once(spark, stub, shown, tmp_path, chat):
    server = model.Server(stub.url, model="m", key="k", chat=chat, wait=0)
    backend = model.model_backend(server, f"file://{tmp_path}/answers", waves=2, clients=2)
    got = told(shown, backend)
    questions = {(r.candidate, r.order_idx) for r in shown.select("candidate", "order_idx").distinct().collect()}
    assert {k[:2] for k in got} == questions and {v for k, v in got.items() if k[2] != " B"} <= {0.9}
    assert {k[1:]: v for k, v in got.items() if k[0] == 1} == {k[1:]: v for k, v in got.items() if k[0] == 2}
    asked = len(stub.seen)
    assert asked == len({json.dumps(b) for _, _, b in stub.seen}) == len({k for k in questions if k[0] != 2})  # what is the same is asked once
    assert {p for p, _, _ in stub.seen} == {"/v1/chat/completions" if chat else "/api/generate"} and {a for _, a, _ in stub.seen} == {"Bearer k"}
    assert told(shown, backend) == got and len(stub.seen) == asked
    assert model.latency(spark.read.parquet(f"file://{tmp_path}/answers")).first().calls == asked


def test_unreadable_answers_fail_their_candidate_and_failures_in_between_pass(stub, shown):
    backend = model.model_backend(model.Server(stub.url, wait=0), clients=1)
    stub.script = [(500, b"busy"), (503, b"busy")] + [(200, b"no json")] * 200
    options = judge.readout(shown, backend(shown)).collect()
    assert {r.candidate for r in options} == {1, 2, 3} and all(r.failed and r.prob is None for r in options)


def test_a_server_that_is_down_fails_the_job(spark, stub, shown, tmp_path):
    store = f"file://{tmp_path}/answers"
    backend = model.model_backend(model.Server(stub.url, wait=0), store, clients=1)
    stub.script = [(500, b"")] * 1000
    with pytest.raises(PythonException, match="3 calls in a row failed"):
        backend(shown)
    assert spark.read.parquet(store).count() == 0  # nothing half done counts as answered
    stub.script = []
    assert {k[0] for k in told(shown, backend)} == {1, 2, 3}


@pytest.mark.parametrize("url", ["http://10.0.0.1:80", "https://127.0.0.1", "http://example.com", "ftp://127.0.0.1", "127.0.0.1:80", ""])
def test_texts_stay_on_the_machine(url):
    with pytest.raises(ValueError):
        model.model_backend(model.Server(url))
    assert model.loopback("http://[::1]:8080/x/") == ("::1", 8080, "/x")
