import http.server
import io
import json
import threading

from pyspark.sql import functions as F

from quarry.operators import models
from quarry.operators.models import HttpModel, generate, reachable, timed_knn
from quarry.operators.retrieval import hashed_embedding


class Echo(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        self.send_response(200)
        self.end_headers()

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps({"text": body["prompt"].upper()}).encode())

    def log_message(self, *_):
        pass


def test_http_model_and_probe(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Echo)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"

    def make():
        return HttpModel(url, lambda p: {"prompt": p}, lambda r: r["text"])

    assert reachable(url) and make().generate("hi") == "HI"
    rows = spark.createDataFrame([(1, "abc"), (2, None)], "id int, prompt string")
    assert {(r.id, r.reply) for r in generate(rows, make).collect()} == {(1, "ABC"), (2, "")}
    server.shutdown()
    server.server_close()
    assert not reachable(url, 0.5) and make().generate("x").startswith("Error: ")


def test_timed_retrieval(spark):
    texts = spark.createDataFrame([(1, "a b"), (2, "c")], "query_id long, text string")
    v = spark.createDataFrame([(5, "a b c"), (6, "c c")], "id long, text string").select("id", hashed_embedding(F.col("text")).alias("embedding"))
    found, ms = timed_knn(texts, v, hashed_embedding, 1)
    assert {(r.query_id, r.id) for r in found.collect()} == {(1, 5), (2, 6)}
    assert set(ms) == {"embedding_ms", "retrieval_ms", "reranking_ms", "llm_ms", "total_ms"} and ms["total_ms"] > 0


def test_wire_formats(monkeypatch):
    """What each service is sent, and where its reply stands."""
    seen = []

    def answer(reply):
        def urlopen(request, timeout):
            seen.append((request.full_url, dict(request.header_items()), json.loads(request.data)))
            return io.BytesIO(json.dumps(reply).encode())

        monkeypatch.setattr("urllib.request.urlopen", urlopen)

    answer({"response": "a"})
    assert models.generate_api("m").generate("p") == "a" and seen[-1][0].endswith("/api/generate") and seen[-1][2]["prompt"] == "p"
    answer({"choices": [{"message": {"content": "b"}}]})
    assert models.chat_api("m", "k").generate("p") == "b" and seen[-1][1]["Authorization"] == "Bearer k" and seen[-1][2]["messages"][0]["content"] == "p"
    answer({"content": [{"type": "text", "text": "c"}, {"type": "text", "text": "d"}]})
    assert models.messages_api("m", "k").generate("p") == "cd" and seen[-1][1]["X-api-key"] == "k"
    answer({"unexpected": 1})
    assert models.chat_api("m", "k").generate("p").startswith("Error")


def test_local_model_is_loaded_once_and_when_asked(monkeypatch):
    model, loads = models.LocalModel("m"), []
    monkeypatch.setattr(models.LocalModel, "load", lambda self: loads.append(1) or (lambda prompt, **_: [{"generated_text": prompt + " reply "}]))
    assert model.pipeline is None and [model.generate("say"), model.generate("x")] == ["reply", "reply"] and len(loads) == 1
    monkeypatch.undo()
    try:
        import transformers  # noqa: F401
    except ImportError:
        assert models.LocalModel("m").generate("p").startswith("Error")
