"""Generators, readers, configuration and the memory facade."""

import json
import sys

import pytest

from recallgrid.operators.memory import Memory, Settings
from recallgrid.sources import experiment as X
from recallgrid.sources import generators as G
from recallgrid.sources import readers as R
from recallgrid.sources.registry import dataset, run_external


def test_synthetic_is_reproducible(spark):
    rows = list(G.synthetic_rows(list(G.TASKS), 3, 4, 1))
    assert rows == list(G.synthetic_rows(list(G.TASKS), 3, 4, 1)) and len(rows) == 24
    for example_id, task, _, answers, evidence, negatives, events in rows:
        ids = [e[0] for e in events]
        assert len(set(ids)) == len(ids) and set(evidence) <= set(ids) and set(negatives) <= set(ids) and answers
    assert dataset(spark, "synthetic", n=2, distractors=2, limit=5).count() == 5
    with pytest.raises(ValueError):
        dataset(spark, "nothing")


def test_continual_lags(spark):
    got = [r.evidence_ids for r in G.continual(spark, 4, (0, 1), 0).collect()]
    assert got == [["continual-0-fact"], ["continual-0-fact"], ["continual-2-fact"], ["continual-2-fact"]]


def test_other_generators(spark):
    for f in (G.contextual, G.overlapping, G.prospective, G.novelty_stream, G.state_tensors):
        assert f(spark, 3).count() == 3


def test_session_reader(spark, tmp_path):
    data = [{"question_id": "q1", "question_type": "t", "question": "Where?", "answer": "here", "haystack_session_ids": ["a", "b"], "haystack_dates": ["2024/01/01", "2024/01/02"], "haystack_sessions": [[{"role": "user", "content": "x"}, {"role": "assistant", "content": "y"}], []], "answer_session_ids": ["b"]}]
    path = tmp_path / "s.json"
    path.write_text(json.dumps(data))
    row = R.session_qa(spark, str(path)).first()
    assert row.events[0].text == "user: x\nassistant: y" and row.events[1].text == "" and row.evidence_ids == ["q1:b"]


def test_dialogue_reader(spark, tmp_path):
    talk = {"session_10": [{"speaker": "B", "dia_id": "D10:1", "text": "later"}], "session_2": [{"speaker": "A", "dia_id": "D2:1", "text": "first"}], "session_2_date_time": "monday"}
    path = tmp_path / "d.json"
    path.write_text(json.dumps([{"sample_id": "s", "conversation": talk, "qa": [{"question": "q", "answer": "a", "category": 2, "evidence": ["D10:1"]}]}]))
    row = R.dialogue_qa(spark, str(path)).first()
    assert [e.text for e in row.events] == ["A: first", "B: later"] and row.events[0].timestamp == "monday" and row.evidence_ids == ["s:D10:1"] and row.task == "category_2"


def test_other_readers(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text(json.dumps({"_id": "1", "input": "q", "context": "c", "answers": ["a"], "dataset": "d"}) + "\n")
    assert R.long_context(spark, str(path)).first().events[0].event_id == "1:context"
    path.write_text(json.dumps({"_id": "1", "question": "q", "choice_A": "w", "choice_B": "x", "choice_C": "y", "choice_D": "z", "answer": "B", "context": "c"}) + "\n")
    assert R.multiple_choice(spark, str(path), lines=True).first().query == "q\nA. w\nB. x\nC. y\nD. z"
    path.write_text(json.dumps({"index": "4", "input": "long", "outputs": ["o"]}) + "\n")
    assert R.prompts(spark, str(path)).first().example_id == "prompts:4"
    path.write_text(json.dumps({"question_id": "f", "prompt": "p", "answers": "[\"a\", \"b\"]", "history": "h"}) + "\n")
    row = R.flexible_qa(spark, str(path)).first()
    assert (row.query, row.answers, [e.text for e in row.events]) == ("p", ["a", "b"], ["h"])


def test_chunked_examples(spark):
    ev = [("e1", "0123456789" * 3, None, None), ("e2", "", None, None)]
    df = spark.createDataFrame([("x", "t", "q", ["a"], ["e1", "missing"], ["e2"], ev)], R.EXAMPLE)
    row = R.chunked(df, 20, 5).first()
    assert [e.event_id for e in row.events] == ["e1:chunk:0", "e1:chunk:1", "e2:chunk:0"]
    assert row.evidence_ids == ["e1:chunk:0", "e1:chunk:1", "missing"] and row.negative_ids == ["e2:chunk:0"]
    assert R.example_index(df).first().n_events == 2


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("SIZE", "12")
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"name": "${NAME_NOT_SET:-x}", "memory": {"graph": {"rule": "hebb"}}, "notes": "${SIZE}"}))
    c = X.load_config(str(path))
    assert (c["name"], c["notes"], c["memory"]["graph"]["rule"], c["memory"]["graph"]["maxdegree"]) == ("x", "12", "hebb", 128)
    with pytest.raises(ValueError):
        X.resolve({"memory": {"graph": {"unknown": 1}}})
    with pytest.raises(KeyError):
        X.expand_env("${NAME_NOT_SET}")
    made = X.ablation_configs(c, {"rule": ["hebb", "oja"], "other": [1]}, {"rule": "memory.graph.rule"})
    assert [(n, m["memory"]["graph"]["rule"], missed) for n, m, missed in made] == [("hebb-1", "hebb", ["other"]), ("oja-1", "oja", ["other"])]
    assert X.overlay({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_external_program():
    code = "import json,sys; r=json.load(open(sys.argv[1])); json.dump({'n': r['n'] + 1}, open(sys.argv[2], 'w'))"
    assert run_external([sys.executable, "-c", code, "{input}", "{output}"], {"n": 1}) == {"n": 2}
    with pytest.raises(RuntimeError):
        run_external([sys.executable, "-c", "raise SystemExit(3)"], {})


def test_memory_recalls_and_forgets(spark, tmp_path):
    rows = [("m", "a", 1, "The code for lantern is 12345."), ("m", "b", 2, "Avery placed a kettle in locker 7."), ("m", "c", 3, "Blake owns the violin."), ("n", "d", 1, "The code for lantern is 99999.")]
    memory = Memory(Settings(dimension=4096, rule="hebb")).write(spark.createDataFrame(rows, "ns string, episode_id string, seq long, text string"))
    ask = spark.createDataFrame([("m", "q1", "What is the code for lantern?")], "ns string, query_id string, text string")
    got = {r.rank: r.episode_id for r in memory.ask(ask).collect()}
    assert got[1] == "a" and "d" not in got.values()
    memory.save(str(tmp_path / "m"))
    again = Memory.load(spark, str(tmp_path / "m"), memory.settings)
    assert {r.rank: r.episode_id for r in again.ask(ask).collect()} == got
    memory.forget(spark.createDataFrame([("m", "a")], "ns string, episode_id string"))
    assert "a" not in {r.episode_id for r in memory.ask(ask).collect()}


def test_chunks_of_tokens_and_their_metadata(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    text = "The quick brown fox, naïve as ever,\njumps over the lazy dog; 日本 too."
    ev = [("e1", text, "2024-01-01", '{"speaker":"x","chunk_unit":"old"}'), ("e2", "", None, None)]
    df = spark.createDataFrame([("x", "t", "q", ["a"], ["e1"], ["e2"], ev)], R.EXAMPLE)
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        path = public_tokenizers.path(name)
        encode, decode = R.token_coder(path)
        ids = encode(text)
        row = R.chunked(df, 6, 2, "tokens", path).first()
        starts = list(range(0, len(ids), 4))
        assert [e.text for e in row.events] == [decode(ids[s : s + 6]) for s in starts] + [""]
        meta = [json.loads(e.metadata) for e in row.events]
        assert meta[1] == {"speaker": "x", "parent_event_id": "e1", "chunk_index": "1", "chunk_start": "4", "chunk_end": "10", "chunk_unit": "tokens"}
        assert meta[-1]["chunk_end"] == "0" and row.events[0].timestamp == "2024-01-01"
        assert row.evidence_ids == [f"e1:chunk:{k}" for k in range(len(starts))]
    assert Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids == R.token_coder(public_tokenizers.path("byte_bpe_50k.json"))[0](text)
    words = R.chunked(df, 3, 0, "words").first()
    assert json.loads(words.events[1].metadata)["chunk_start"] == "3" and json.loads(words.events[1].metadata)["chunk_unit"] == "words"
    for unit, path in (("lines", None), ("tokens", None), ("tokens", "model.bin")):
        with pytest.raises(ValueError):
            R.chunked(df, 6, 2, unit, path)
