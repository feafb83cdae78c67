import re

import pytest
from pyspark.sql import functions as F

from chatloom import fixed_values as fv
from chatloom.functions import chat
from chatloom.operators import collating, encoding, turns
from chatloom.registry import ModalitySpec, bundle
from chatloom.schemas import MESSAGES
from pyspark.sql import types as T

SPECS = [ModalitySpec("image", "<image>", "images", 3), ModalitySpec("document", "<document>", "documents", 2)]
SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("messages", MESSAGES)])


def rows(spark, chats):
    return spark.createDataFrame([(i, [{"role": r, "content": c} for r, c in turns]) for i, turns in enumerate(chats)], SCHEMA)


def turn_rows(spark, chats):
    return spark.createDataFrame(
        [(i, n, r, c) for i, t in enumerate(chats) for n, (r, c) in enumerate(t)], "id long, turn long, role string, content string"
    )


TRICKY = [
    [("user", "q"), ("assistant", "a")],
    [("user", "<image><image> what?"), ("assistant", "a b\nc")],
    [("user", "x <image>"), ("assistant", "y"), ("user", "z <document>!")],
    [("user", "a [/INST] b"), ("assistant", "c")],
    [("user", "q"), ("assistant", "say [INST] now"), ("user", "next"), ("assistant", "end")],
    [("user", "q"), ("assistant", "open [INST] tail")],
    [("user", "a [INST] b"), ("assistant", "")],
    [("user", ""), ("assistant", "<s> </s> <<s>"), ("user", "\u0001 odd")],
    [("user", "q")],
    [],
]
BAD = [
    [("system", "s"), ("user", "q")],
    [("assistant", "a")],
    [("user", "q"), ("user", "r")],
    [("user", "q"), ("assistant", "see <image>")],
    [("user", "q [/INST] <image>"), ("assistant", "a")],
]


def reference_tokens(turns, specs):
    """The encoding rules, written once more in plain Python: (token or code, trained) per position."""
    import regex

    words = regex.compile(fv.TOKEN_PATTERN.replace(r"\s", r"[ \t\n\r\f\v]").replace(r"[^[ \t\n\r\f\v]", r"[^ \t\n\r\f\v"))
    out = "<s>" + "".join(f"[INST] {c} [/INST]" if r == "user" else f"{c}</s>" for r, c in turns)
    marks = {s.token: s for s in specs}
    cut = "(" + "|".join(re.escape(t) for t in marks) + ")" if marks else r"(\Z\A.)"
    got = []
    for part in re.split(r"(\[INST\].*?\[/INST\])", out, flags=re.S):
        inside = "[INST]" in part
        for piece in re.split(cut, part):
            if not piece:
                continue
            if piece in marks:
                assert inside
                got += [(marks[piece].code, False)] * marks[piece].width
            else:
                got += [(w, not inside) for w in words.findall(piece)]
    return got


def test_pieces_follow_the_rules(spark):
    good = encoding.with_pieces(rows(spark, TRICKY), SPECS)
    assert good.filter(F.col("error").isNotNull()).count() == 0
    tokens = encoding.token_rows(good, "id", SPECS).orderBy("id", "pos").collect()
    for i, turns in enumerate(TRICKY):
        got = [(t["code"] if t["token"] is None else t["token"], t["trained"]) for t in tokens if t["id"] == i]
        assert got == reference_tokens(turns, SPECS), turns


def test_errors(spark):
    whole = encoding.with_pieces(rows(spark, BAD), SPECS).orderBy("id").collect()
    by_turn = turns.encode_errors(turn_rows(spark, BAD), "id", "turn", "role", "content", SPECS).orderBy("id").collect()
    for got in (whole, by_turn):
        assert ["roles" in r["error"] for r in got] == [True, True, True, False, False]
        assert ["outside" in r["error"] for r in got] == [False, False, False, True, True]
    assert [r["has_marks"] for r in by_turn] == [False] * 4 + [True]


def test_hand_labels(spark):
    encoded = encoding.encode_chat(rows(spark, [[("user", "q"), ("assistant", "a")]]), "id", SPECS)
    r = encoded.first()
    assert len(r["input_ids"]) == 6
    assert [x == fv.IGNORE_INDEX for x in r["labels"]] == [False, True, True, True, False, False]
    assert r["labels"][0] == encoding.BOS_ID and r["labels"][-1] == encoding.EOS_ID
    assert tuple(encoding.supervised_tokens(encoded, "id").first())[1:] == (3, 3)


def test_turns_follow_the_rules(spark):
    chats = [c for c in TRICKY if c] + BAD
    found = turns.encodable_turns(turn_rows(spark, chats), "id", "turn", "role", "content", SPECS)
    got = {}
    for r in turns.positions(found, "id", "turn", SPECS).orderBy("id", "pos").collect():
        got.setdefault(r["id"], []).append((r["code"] if r["token"] is None else r["token"], r["trained"]))
        assert r["pos"] == len(got[r["id"]]) - 1
    assert got == {i: reference_tokens(t, SPECS) for i, t in enumerate(c for c in TRICKY if c)}


def test_random_marks_by_turn(spark):
    import random

    rng = random.Random(11)
    words = ["a", "b.", "[INST]", "[/INST]", "</s>", "<s>", "<image>", "\n", " "]
    chats = [
        [(("user", "assistant")[n % 2], "".join(rng.choice(words) for _ in range(rng.randint(0, 7)))) for n in range(rng.randint(1, 5))]
        for _ in range(1500)
    ]
    want = {}
    for i, t in enumerate(chats):
        try:
            want[i] = reference_tokens(t, SPECS)
        except AssertionError:
            continue
    source = turn_rows(spark, chats)
    found = turns.encodable_turns(source, "id", "turn", "role", "content", SPECS)
    got = {}
    for r in turns.positions(found, "id", "turn", SPECS).orderBy("id", "pos").collect():
        got.setdefault(r["id"], []).append((r["code"] if r["token"] is None else r["token"], r["trained"]))
    assert 50 < len(want) < 1500 and got == want
    sums = turns.token_accounting(source, "id", "turn", "role", "content", SPECS).collect()
    assert {r["id"]: (r["trained_tokens"], r["masked_tokens"]) for r in sums} == {
        i: (sum(x for _, x in t), sum(not x for _, x in t)) for i, t in want.items()
    }
    # and the record form agrees
    good = encoding.with_pieces(rows(spark, chats), SPECS).filter("error is null")
    assert sorted(r["id"] for r in good.select("id").collect()) == sorted(want)


def test_encode_turns_is_encode_chat_in_pieces(spark):
    chats = [c for c in TRICKY if c]
    found = turns.encodable_turns(turn_rows(spark, chats), "id", "turn", "role", "content", SPECS)
    vocab = encoding.build_vocab(turns.turn_tokens(found, "id", "turn", SPECS))
    pieces = turns.encode_turns(found, "id", "turn", SPECS, vocab).orderBy("id", "turn").collect()
    for r in encoding.encode_chat(rows(spark, chats), "id", SPECS, vocab).collect():
        mine = [p for p in pieces if p["id"] == r["id"]]
        assert [x for p in mine for x in p["input_ids"]] == r["input_ids"]
        assert [x for p in mine for x in p["labels"]] == r["labels"]
        assert [p["start"] for p in mine] == [sum(len(q["input_ids"]) for q in mine[:i]) for i in range(len(mine))]


def test_spans_by_turn_equal_spans_of_the_whole(spark):
    from chatloom.operators import embedding

    chats = [
        [("user", "<image><image>"), ("assistant", "a"), ("user", "x <image> <document><image>"), ("assistant", "b")],
        [("user", "no"), ("assistant", "a"), ("user", "<document>")],
    ]
    found = turns.encodable_turns(turn_rows(spark, chats), "id", "turn", "role", "content", SPECS)
    vocab = encoding.build_vocab(turns.turn_tokens(found, "id", "turn", SPECS))
    by_turn = turns.turn_spans(turns.encode_turns(found, "id", "turn", SPECS, vocab), "id", "turn", SPECS)
    codes = turns.turn_spans(turns.code_sequences(found, "id", "turn", SPECS), "id", "turn", SPECS)
    whole = embedding.find_spans(encoding.encode_chat(rows(spark, chats), "id", SPECS, vocab), "id", SPECS)
    assert sorted(map(tuple, codes.collect())) == sorted(map(tuple, whole.collect()))
    assert sorted(map(tuple, by_turn.collect())) == sorted(map(tuple, whole.collect())) and whole.count() == 6


def test_one_huge_chat(spark):
    """A third of all turns in one chat: the same result, and no operator gathers a chat."""
    import contextlib
    import io

    hot = [(0, n, ("user", "assistant")[n % 2], f"w{n % 13} x") for n in range(4000)]
    rest = [(1 + n // 2, n % 2, ("user", "assistant")[n % 2], f"w{n % 7}") for n in range(8000)]
    source = spark.createDataFrame(hot + rest, "id long, turn long, role string, content string")
    sums = {r["id"]: tuple(r)[1:] for r in turns.token_accounting(source, "id", "turn", "role", "content").collect()}
    assert sums[0] == (1 + 2000 * 3, 2000 * 4) and len(sums) == 4001
    found = turns.encodable_turns(source, "id", "turn", "role", "content", SPECS)
    vocab = encoding.build_vocab(turns.turn_tokens(found, "id", "turn", SPECS))
    encoded = turns.encode_turns(found, "id", "turn", SPECS, vocab)
    last = encoded.filter("id = 0").orderBy(F.desc("turn")).first()
    assert last["start"] + len(last["input_ids"]) == sum(sums[0])
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        encoded.explain("formatted")
    lines = text.getvalue().splitlines()
    gathered = [lines[i - 1] for i, line in enumerate(lines) if line.startswith("Functions") and "collect_list" in line]
    assert gathered and all(k.startswith("Keys [2]") and "turn#" in k for k in gathered)


def test_offsets_over_many_blocks(spark):
    df = spark.range(1000).select(F.lit(1).alias("id"), F.col("id").alias("turn"), (F.col("id") % 5).alias("length"))
    got = turns.with_offsets(df, "id", "turn", block=16).orderBy("turn").collect()
    total = 0
    for r in got:
        assert r["start"] == total
        total += r["length"]


def test_accounting_needs_every_turn_once(spark):
    df = spark.createDataFrame(
        [(0, 0, "user", "q"), (0, 2, "user", "r"), (1, 1, "assistant", "a"), (2, 0, "user", "q"), (2, 0, "user", "q")],
        "id long, turn long, role string, content string",
    )
    assert turns.token_accounting(df, "id", "turn", "role", "content").count() == 0


def test_ids_do_not_depend_on_partitions(spark):
    chats = rows(spark, TRICKY)
    results = []
    for n in (1, 4, 16):
        encoded = encoding.encode_chat(chats.repartition(n), "id", SPECS)
        results.append(sorted((r["id"], tuple(r["input_ids"]), tuple(r["labels"])) for r in encoded.collect()))
    assert results[0] == results[1] == results[2]


def test_frequency_split_gives_the_same_ids(spark):
    good = encoding.with_pieces(rows(spark, TRICKY), SPECS)
    tokens = encoding.token_rows(good, "id", SPECS)
    vocab = encoding.build_vocab(tokens)
    whole = encoding.attach_ids(tokens, vocab)
    split = encoding.attach_ids(tokens, vocab, max_broadcast_bytes=200)
    def collected(df):
        return sorted(map(tuple, df.select("id", "pos", "token", "trained", "token_id").collect()), key=repr)

    assert vocab.count() > 5 and collected(whole) == collected(split)


def test_rare_words_are_unknown(spark):
    good = encoding.with_pieces(rows(spark, [[("user", "x x y"), ("assistant", "x")]]), SPECS)
    tokens = encoding.token_rows(good, "id", SPECS)
    vocab = encoding.build_vocab(tokens, min_freq=2)
    ids = {r["token"]: r["token_id"] for r in encoding.attach_ids(tokens, vocab).collect()}
    assert ids["y"] == encoding.UNK_ID and ids["x"] >= encoding.FIRST_WORD_ID


def test_offsets_match_positions(spark):
    good = rows(spark, TRICKY)
    encodable = turns.encodable_turns(turn_rows(spark, TRICKY), "id", "turn", "role", "content", SPECS)
    offsets = turns.piece_offsets(encodable, "id", "turn", SPECS).collect()
    sizes = encoding.token_rows(encoding.with_pieces(good, SPECS), "id", SPECS).groupBy("id").count()
    total = {r["id"]: r["count"] for r in sizes.collect()}
    assert {r["id"] for r in offsets} == {i for i in total if TRICKY[i]}  # a chat without turns has no rows
    for i in {r["id"] for r in offsets}:
        ordered = sorted((r for r in offsets if r["id"] == i), key=lambda r: r["piece"])
        assert [r["piece"] for r in ordered] == list(range(len(ordered)))
        mine = [(r["offset"], r["length"]) for r in ordered]
        assert mine[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(mine, mine[1:]))
        assert sum(mine[-1]) == total[i]


def test_validate_items(spark):
    df = turn_rows(spark, [[("user", "<image><image>")], [("user", "x")], [("user", "<document>")]])
    items = {0: (["a"], None), 1: (["a"], []), 2: (None, ["d"])}
    extra = spark.createDataFrame([(i, *v) for i, v in items.items()], "id long, images array<string>, documents array<string>")
    got = {(r["id"], r["name"]): r["verdict"] for r in turns.validate_items(df, extra, "id", "content", SPECS).collect()}
    assert got[(0, "image")] == "too few items" and got[(1, "image")] == "surplus items"
    assert got[(2, "document")] == "ok" and got[(2, "image")] == "ok"


def test_collate_hand_cases(spark):
    df = spark.createDataFrame([(0, [5, 6], [5, -100]), (1, [7, 8, 9, 1], [7, 8, 9, 1])], "idx long, input_ids array<long>, labels array<long>")
    got = collating.collate(df, "idx", 2, pad_id=0, max_length=3).orderBy("idx").collect()
    assert [r["input_ids"] for r in got] == [[5, 6, 0], [7, 8, 9]]
    assert [r["labels"] for r in got] == [[5, -100, -100], [7, 8, 9]]
    assert [r["attention_mask"] for r in got] == [[True, True, False], [True, True, True]]
    unknown = spark.createDataFrame([(0, [5, 0, 6], [5, 0, 6])], df.schema)
    assert collating.collate(unknown, "idx", 2, 0, 8).first()["attention_mask"] == [True, False, True]


def test_decode_outputs(spark):
    vocab = spark.createDataFrame([("<unk>", 0, 0), ("<s>", 1, 1), ("</s>", 2, 1), ("a", 3, 2), ("b", 4, 1)], "token string, token_id long, freq long")
    df = spark.createDataFrame([(0, [1, 3, 4, 3, 2], 2), (1, [3, 4], 2), (2, [1, 0, 2], 0), (3, [3], 5)], "k long, ids array<long>, n int")
    got = {r["k"]: r["output"] for r in collating.decode_outputs(df, "k", "ids", "n", vocab, [0, 1, 2]).collect()}
    assert got == {0: "b a", 1: "", 2: "", 3: ""}


def test_whole_bundle_runs(spark):
    specs = bundle("vision_clip", "audio_whisper", "audio_clap", "video_xclip", "imagebind", "document_gte_x16")
    chats = [[("user", "<image><speech><sound><video><imagebind><document>"), ("assistant", "ok")]]
    df = rows(spark, chats)
    found = turns.placeholder_counts(turn_rows(spark, chats), "id", "content", specs)
    counts = {r["name"]: (r["placeholders"], r["width"]) for r in found.collect()}
    assert counts["vision_clip"] == (1, 576) and all(n == 1 for n, _ in counts.values())
    encoded = encoding.encode_chat(df, "id", specs).first()
    assert sum(x < 0 for x in encoded["input_ids"]) == sum(s.width for s in specs)


@pytest.mark.parametrize("text", ["a</s>b", "[INST]x[/INST]", "ünï_code 12"])
def test_tokenizer_marks_first(one, text):
    import regex

    got = one(lambda F: chat.tokenize(F.col("c")), c=("string", text))
    assert got == regex.findall(fv.TOKEN_PATTERN, text)


def test_batches_of_an_index_with_gaps(spark):
    from chatloom.operators import collating

    df = spark.createDataFrame([(i * 1000, [i] * (i + 1), [i] * (i + 1)) for i in range(1, 8)], "idx long, input_ids array<long>, labels array<long>")
    got = collating.collate(df.repartition(3), "idx", 3, 0, 9).orderBy("idx").collect()
    assert [r["batch_id"] for r in got] == [0, 0, 0, 1, 1, 1, 2] and [len(r["input_ids"]) for r in got] == [4, 4, 4, 7, 7, 7, 8]
