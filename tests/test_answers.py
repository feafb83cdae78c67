import json
import os
import time

import pytest
from pyspark.sql import functions as F

from chatloom.operators.answers import ask_once, logged_answers
from chatloom.operators.sampling import drawn_row, next_attempts
from chatloom.plans import builders

RESPONSE = "shard bigint, attempt bigint, response string"


def counting_model(calls, broken):
    """A model called in tasks: each call leaves a line in a file of its own; while ``broken`` exists one task fails."""

    def answer(batches):
        for rows in batches:
            if os.path.exists(broken) and (rows["attempt"] % 4 == 3).any():
                time.sleep(4)  # the other tasks finish
                raise ConnectionError("no more answers")
            with open(f"{calls}/{os.getpid()}-{time.time_ns()}", "w") as f:
                for shard, attempt in zip(rows["shard"], rows["attempt"]):
                    f.write(f"{shard}:{attempt}\n")
            text = [json.dumps({"question": "q", "answer": f"{s}-{a}"}) if a % 3 == 0 else "{" for s, a in zip(rows["shard"], rows["attempt"])]
            yield rows[["shard", "attempt"]].assign(response=text)

    def respond(requests):
        # attempts with the same rest by 4 in one task
        return requests.repartitionById(4, (F.col("attempt") % 4).cast("int")).mapInPandas(answer, RESPONSE)

    return respond


def called(calls):
    return sorted(tuple(map(int, line.split(":"))) for name in os.listdir(calls) for line in open(f"{calls}/{name}"))


def test_every_attempt_is_asked_once_also_after_an_abort(spark, tmp_path):
    calls, broken, log = str(tmp_path / "calls"), str(tmp_path / "broken"), str(tmp_path / "log")
    os.mkdir(calls)
    open(broken, "w").close()
    model = counting_model(calls, broken)

    def build():
        return builders._draw_answers(spark, 20, model, 2, 8, "d", lambda a: a, log)

    with pytest.raises(Exception, match="no more answers"):
        build()
    before = called(calls)
    assert before and all(a % 4 != 3 for _, a in before)
    kept = {(r["shard"], r["attempt"]) for r in logged_answers(spark, log, "d").collect()}
    assert kept == set(before)  # finished tasks are in the log although their job failed
    os.remove(broken)
    rows = build().collect()
    after = called(calls)
    assert len(after) == len(set(after)) and set(before) <= set(after)
    assert sorted((r["shard"], r["slot"], r["attempt"], r["answer"]) for r in rows) == [(s, i, 3 * i, f"{s}-{3 * i}") for s in range(2) for i in range(8)]
    assert build().count() == 16 and called(calls) == after  # a finished build asks for nothing


def test_silence_and_other_draws(spark, tmp_path):
    """No answer is an answer; draws of other names and of other sources do not take one another's."""
    log, asked = str(tmp_path / "log"), []
    shards = spark.createDataFrame([(0, 0, 6), (1, 2, 4)], "shard bigint, first bigint, last bigint")

    def ask(todo):
        asked.append(sorted((r["shard"], r["attempt"]) for r in todo.collect()))
        return todo.filter(F.col("attempt") % 2 == 0).select("shard", "attempt", F.lit("x").alias("response"))

    def run(draw, rows):
        return sorted((r["shard"], r["attempt"], r["response"]) for r in ask_once(next_attempts(shards, rows, draw), ask, log, draw, drawn_row(draw, rows)).collect())

    every = [(0, a) for a in range(6)] + [(1, 2), (1, 3)]
    want = [(s, a, "x" if a % 2 == 0 else None) for s, a in every]
    assert run("d", 10) == want and run("d", 10) == want
    assert asked == [every]
    assert run("e", 10) == want and asked == [every] * 2
    run("d", 1000)
    assert len(asked) == 3 and 0 < len(asked[2]) <= 8
    assert run("d", 10) == want and len(asked) == 3


def test_captions_go_through_the_log(spark, tmp_path):
    sounds = spark.range(5).select(F.col("id").alias("idx"), F.concat(F.lit("u"), "id").alias("url"), F.lit("tag").alias("tags"))
    asked = []

    def model(requests):
        asked.append(requests.count())
        return requests.select("idx", F.to_json(F.struct(F.lit("c").alias("caption"))).alias("response"))

    for _ in range(2):
        assert builders.sound_captions(sounds, model, log=str(tmp_path / "log")).count() == 5
    assert asked == [5]
