import hashlib
import json
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from notemill import runs
from notemill.operators import backends, judge, judging as g

METHODS = ["ours", "raw_to_note", "chunk_fact_to_note"]
OPPONENT = "raw_to_note"


def notes(spark):
    rows = []
    for m in METHODS:
        for k in range(8):
            if (m, k) != ("chunk_fact_to_note", 7):
                note = "" if (m, k) in (("ours", 1), (OPPONENT, 2), ("ours", 2)) else f"note {m} {k}"
                rows.append((m, f"r{k}", f"p{k % 2}", note, f"source {k}", f"truth of {k} " * (k + 2)))
    return spark.createDataFrame(rows, "method string, record_id string, professor string, note string, source string, gt string")


def sample(spark):
    return spark.createDataFrame([(f"r{k}",) for k in range(8) if k != 4] + [("other",), ("r0",)], "record_id string")


def number(task, user):
    return int(hashlib.sha256((task + user).encode()).hexdigest()[:8], 16)


def block(rows, professor, record):
    refs = sorted(((len(r.gt.strip()), r.record_id, r.gt.strip()) for r in rows if r.method == METHODS[0] and r.professor == professor))
    texts = [t for _, i, t in refs if i != record][:3]
    return "\n\n".join(f"[Reference {k}]\n{t}" for k, t in enumerate(texts, 1)) or "(no reference available)"


def test_evaluation_equals_a_plain_loop(spark):
    df, cache = notes(spark), spark.createDataFrame([], "key string, response string")
    config = backends.Config(model="m", json=True)
    verdicts, answers, fresh = g.evaluate(df, sample(spark), METHODS, OPPONENT, config, cache)
    rows = df.collect()
    at = {(r.method, r.record_id): r for r in rows}
    tag = lambda n, x: f"<{n}>\n{x.strip()}\n</{n}>\n"
    want = {}
    for (m, i), r in at.items():
        if i == "r4":
            continue
        c = number("completeness", tag("reference", r.gt) + tag("note", r.note))
        absent = int(c % 4 == 0)
        other = at[OPPONENT, i].note
        if not r.note:
            style = None if m == OPPONENT or not other else 0.0
            want[m, i] = (True, 1, 0, 0, 2, absent, False, False, style)
            continue
        f = number("faithfulness", tag("source", r.source) + tag("note", r.note))
        style = None
        if m != OPPONENT:
            style = 1.0
            if other:
                head = block(rows, r.professor, i) + "\n"
                first, second = (number("style", head + tag("note_a", a) + tag("note_b", b)) % 3 for a, b in ((r.note, other), (other, r.note)))
                style = ((1, 0, 0.5)[first] + (0, 1, 0.5)[second]) / 2
        want[m, i] = (False, 2 if f % 5 == 0 else 3 + f % 3, 1 + (f % 5 == 0), int(f % 5 == 0), 2, absent, not absent, not absent, style)
    got = {(r.method, r.record_id): (r.empty_note, r.likert, r.n_claims, r.n_unsupported, r.n_critical, r.n_absent, r.complete_strict, r.complete_lenient, r.style_score) for r in verdicts.collect()}
    assert got == want and verdicts.where("error is not null").count() == 0
    assert g.claims(answers).count() == sum(w[2] for w in want.values()) and g.critical_facts(answers).where("status = 'absent'").count() == sum(w[5] for w in want.values())
    table = judge.in_order(judge.quality_table(verdicts), METHODS).collect()
    assert [r.method for r in table] == METHODS and [r.n for r in table] == [7, 7, 6]

    class Never:
        def __init__(self, config):
            pass

        def chat(self, system, user):
            raise RuntimeError("all answers are known")

    again, _, more = g.evaluate(df, sample(spark), METHODS, OPPONENT, config, fresh.select("key", "response"), make=Never)
    assert more.count() == 0 and sorted(map(repr, again.collect())) == sorted(map(repr, verdicts.collect()))
    cold, _, none = g.evaluate(df, sample(spark), METHODS, OPPONENT, backends.Config(model="m", json=True, pause=0), cache, make=Never)
    assert none.count() == 0 and cold.where("likert is null and error like '%known%'").count() == len(want)


def test_combined_errors(spark):
    class Judge:
        def __init__(self, config):
            pass

        def chat(self, system, user):
            if "gt_facts" in system:
                return '{"critical_facts": [1, 2, {"fact": "x"}]}'
            return json.dumps({"unsupported_claims": [{"claim": "a", "error_type": " patient_mixing "}, "text", {"claim": "b"}], "missing_critical_facts": [{"fact": "m"}], "patient_mixing_suspected": False})

    jobs = notes(spark).where("method = 'ours' and record_id in ('r0', 'r1')")
    calls = g.calls_of(jobs, jobs, g.style_blocks(jobs.select("professor", "record_id", F.col("gt").alias("output")), jobs), OPPONENT, ("error_analysis", "gt_facts"))
    answers, _ = g.answers_of(calls, spark.createDataFrame([], "key string, response string"), backends.Config(json=True), make=Judge)
    got = {r.record_id: (r.n_unsupported, r.n_missing, r.n_mixing, r.mixing_suspected) for r in g.errors_judged(jobs, answers).collect()}
    assert got == {"r0": (2, 1, 1, True), "r1": (0, 3, 0, False)}


def test_likert_and_counts_of_odd_replies(spark):
    replies = ['{"faithfulness_likert": "5"}', '{"faithfulness_likert": 4.7, "claims": [{"verdict": "unsupported", "error_type": "patient_mixing"}, 3]}', '{"faithfulness_likert": 6, "claims": 1}', '{"critical_facts": [{"status": " Partial "}, "x", {}]}', '{"critical_facts": []}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string").orderBy("i")
    v = F.try_parse_json("r")
    got = df.select(judge.faithfulness(v).alias("f"), judge.completeness(v).alias("c")).collect()
    assert [tuple(r.f) for r in got[:3]] == [(1, 0, 0, 0), (4, 2, 1, 1), (1, 0, 0, 0)]
    assert tuple(got[3].c) == (2, 0, 1, False, True) and tuple(got[4].c) == (0, 0, 0, False, False)


def test_method_frames(spark):
    df = spark.createDataFrame([(1, "a", "p", "n", "i", None), (0, "a", "p", "first", "i", " nan "), (2, "b", "q", "", "i", "o")], "row_index int, record_id string, professor string, generated_note string, Input string, Output string")
    assert sorted(map(tuple, g.method_frame(df, "row_index").collect())) == [("a", "p", "first", "i", ""), ("b", "q", "", "i", "o")]
    with pytest.raises(ValueError, match="Output"):
        g.method_frame(df.drop("Output"), "row_index")
    assert g.methods_of(["a", "b"], "a") == ["a", "b"] and g.methods_of(["a"], "b") == ["a", "b"]


@pytest.fixture
def server():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, body, self.headers.get("Authorization")))
            if self.path == "/chat" and len(seen) == 1:
                return self.answer(503, {"error": "busy"})
            if self.path == "/completions" and "temperature" in body:
                return self.answer(400, {"error": "Unsupported parameter: temperature"})
            text = "<think>x</think>" + json.dumps({"k": 1})
            self.answer(200, {"message": {"content": text}} if self.path == "/chat" else {"choices": [{"message": {"content": text}}]})

        def answer(self, status, body):
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *args):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", seen
    http.shutdown()


def test_servers(server):
    url, seen = server
    chat = backends.Config("http", f"{url}/chat", json=True, pause=0)
    assert backends.JsonClient(backends.client(chat), chat).chat("s", "u") == '{"k": 1}'
    assert len(seen) == 2 and seen[1][1]["options"]["temperature"] == 0 and seen[1][1]["format"] == "json" and seen[1][1]["options"]["seed"] == 1225
    assert backends.available(chat)
    seen.clear()
    c = backends.Config("completions", f"{url}/completions", json=True, key="k", pause=0)
    model = backends.client(c)
    assert '{"k": 1}' in model.chat("s", "u") and '{"k": 1}' in model.chat("s", "u")
    assert ["temperature" in b for _, b, _ in seen] == [True, False, False] and seen[0][2] == "Bearer k" and "k=" not in repr(c).replace("token", "")
    assert not backends.available(backends.Config("http", "http://127.0.0.1:9/none", retries=0))
    with pytest.raises(ValueError):
        backends.Config("other")


@pytest.fixture
def slow_server():
    """A chat server that counts how many calls are in it at once, in all and by model."""
    from collections import Counter
    from http.server import ThreadingHTTPServer

    lock, now, most = threading.Lock(), Counter(), Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            model = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["model"]
            with lock:
                now.update([model, "all"])
                for k in (model, "all"):
                    most[k] = max(most[k], now[k])
            time.sleep(0.15)
            with lock:
                now.subtract([model, "all"])
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"message": {"content": '{"k": 1}'}}).encode())

        def log_message(self, *args):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}/chat", most
    http.shutdown()


def test_calls_in_flight_are_bounded_and_keep_their_order(spark, slow_server):
    url, most = slow_server
    calls = spark.createDataFrame([(k, "s", f"u{k}") for k in range(24)], "k int, system string, user string").repartition(4)
    config = backends.Config("http", url, "m", pause=0, workers=2, at_once=3)
    got = backends.ask(calls, config).collect()
    assert sorted((r.k, r.user, r.response, r.error) for r in got) == [(k, f"u{k}", '{"k": 1}', None) for k in range(24)]
    assert 3 <= most["all"] <= 6
    with pytest.raises(ValueError):
        backends.Config(at_once=0)


def test_configurations_run_side_by_side(spark, slow_server, tmp_path):
    url, most = slow_server
    calls = spark.createDataFrame([(k, "s", f"u{k}") for k in range(8)], "k int, system string, user string").coalesce(1)
    pools = {}

    def work(name):
        def go():
            pools[name] = spark.sparkContext.getLocalProperty("spark.scheduler.pool")
            if name == "broken":
                raise RuntimeError("no model")
            assert backends.ask(calls, backends.Config("http", url, name, pause=0, workers=1, at_once=2)).where("error is null").count() == 8

        return go

    run = runs.create_run(tmp_path, "x")
    names = ["a", "broken", "b", "c"]
    done = runs.side_by_side(spark, run, [(n, work(n)) for n in names], 3)
    assert [(r.stage, r.ok) for r in done] == [(n, n != "broken") for n in names] and "no model" in done[1].error
    assert pools == {n: n for n in names} and spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None
    assert all(1 <= most[n] <= 2 for n in "abc") and most["all"] > 2, most  # they overlap, and none exceeds its own bound
    assert len(list((run.root / "logs").glob("*.json"))) == 4
