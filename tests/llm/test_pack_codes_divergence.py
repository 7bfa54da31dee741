"""Packing, vector codes and the divergence audit against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangeloom.llm import bpe, divergence, packing, vector_codes
from rangeloom.llm.queries import QUERIES, tokenizer_path

LONG = "lorem ipsum dolor sit amet " * 4000


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(tokenizer_path())


# --- packing -----------------------------------------------------------------------------


def first_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        at = next((i for i, g in enumerate(gaps) if g >= n), None)
        if at is None:
            gaps.append(capacity - n)
        else:
            gaps[at] -= n
    return len(gaps)


def bins_one_by_one(lengths, capacity):
    """Best-two-fit without patterns: a bin at a time."""
    left, bins = Counter(lengths), 0
    while left := +left:
        left -= packing.fill(sorted(left), left, capacity)
        bins += 1
    return bins


@pytest.mark.parametrize("capacity", [7, 30, 1024])
@pytest.mark.parametrize("n", [0, 1, 6, 60, 700])
def test_plan_packs_every_piece_as_bins_filled_one_by_one(capacity, n):
    random.seed(capacity + n)
    lengths = [random.randint(1, capacity if random.random() < 0.6 else capacity // 3) for _ in range(n)]
    counts = Counter(lengths)
    made = packing.plan(dict(counts), capacity)
    assert made.bins == bins_one_by_one(lengths, capacity) <= first_fit_decreasing(lengths, capacity) * 1.05 + 1
    if n:
        length = np.repeat(np.array(sorted(counts)), [counts[k] for k in sorted(counts)])
        number = np.concatenate([np.arange(counts[k]) for k in sorted(counts)])
        where, offset = made.place(length, number)
        held = defaultdict(list)
        for b, o, x in zip(where.tolist(), offset.tolist(), length.tolist(), strict=True):
            held[b].append((o, x))
        assert sorted(held) == list(range(made.bins))
        for own in held.values():
            ends = 0
            for o, x in sorted(own):
                assert o == ends
                ends += x
            assert ends <= capacity


def test_two_pieces_replace_the_smallest():
    # Greedily 6 + 2 of 10 leave a gap of 2; 3 + 1 would fit in place of 2 and fill it.
    assert packing.fill([1, 2, 3, 6], Counter({6: 1, 3: 1, 1: 1}), 10) == Counter({6: 1, 3: 1, 1: 1})
    assert packing.fill([3, 5, 6], Counter({6: 1, 5: 1, 3: 2}), 11) == Counter({6: 1, 5: 1})
    assert packing.fill([4, 5, 7], Counter({7: 1, 5: 1, 4: 2}), 15) == Counter({7: 1, 4: 2})  # 7 + 5, then 5 gives way to 4 + 4
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10)


def test_histogram_of_any_size_is_planned_at_once():
    made = packing.plan({k: 10**9 + k for k in range(1, 1025)})
    assert len(made.length) < 10_000
    assert made.bins < 1.02 * math.ceil(sum(k * (10**9 + k) for k in range(1, 1025)) / 1024)


def whole(rows, docs, vocabulary, capacity=1024, end=2):
    """Hold packed rows against the library's ids."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for key, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [end]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[key, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in held.values():
        ends = 0
        for o, n in sorted(own):
            assert o == ends
            ends += n
        assert ends <= capacity
    return len(held)


def test_packing_query(spark, data):
    rows = QUERIES["op11_packing"](spark, data).collect()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    sequences = whole(rows, docs, None)
    total = sum(r["length"] for r in rows)
    assert sequences <= first_fit_decreasing([r["length"] for r in rows], 1024)
    assert sequences <= 1.02 * math.ceil(total / 1024) + 1


def test_packing_odd_rows(spark, vocabulary):
    docs = [(1, None), (2, ""), (2, ""), (None, "a b"), (5, LONG), (6, "x"), (6, "x")] + [(9, "same")] * 40
    frame = spark.createDataFrame([(*d, "z", 1) for d in docs], "doc_id long, text string, sequence_id string, length int")
    packed = packing.pack(frame, vocabulary)
    whole(packed.collect(), docs, vocabulary)
    made = packing.sequences(packed).collect()
    assert all(len(r["ids"]) == sum(r["lengths"]) <= 1024 for r in made)
    text = bpe.Encoder(vocabulary).decode(np.concatenate([r["ids"] for r in sorted(packed.where("doc_id = 5").collect(), key=lambda r: r["piece"])])[:-1])
    assert text == LONG
    assert packing.pack(frame.where("false"), vocabulary).collect() == []
    assert packing.pack(frame.where("text is null"), vocabulary, end=None).collect() == []


# --- vector codes ------------------------------------------------------------------------


def plain_codes(vectors, parts, entries, rounds):
    """Rounds over all entries in plain integers."""
    width = len(vectors[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for v in vectors] for p in range(parts)]
    books = [list(c[:entries]) for c in cut]

    def nearest(x, book):
        return min(range(len(book)), key=lambda i: (sum((a - b) ** 2 for a, b in zip(x, book[i], strict=True)), i))

    for r in range(rounds + 1):
        codes = [[nearest(x, books[p]) for x in cut[p]] for p in range(parts)]
        if r < rounds:
            for p in range(parts):
                for i in range(len(books[p])):
                    own = [x for x, c in zip(cut[p], codes[p], strict=True) if c == i]
                    if own:
                        books[p][i] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    errors = [sum(sum((a - b) ** 2 for a, b in zip(cut[p][n], books[p][codes[p][n]], strict=True)) for p in range(parts)) for n in range(len(vectors))]
    return ["".join(f"{codes[p][n]:02x}" for p in range(parts)) for n in range(len(vectors))], errors, books


def test_vector_codes_equal_plain_rounds(spark):
    random.seed(5)
    # Few distinct values, so ties and unused entries are common.
    vectors = {i * 7 % 97: [random.choice([-1.5, -0.25, 0.0, 0.3, 2.0]) for _ in range(8)] for i in range(97)}
    rows = [(k, v, k % 3 if k % 5 else None, "x") for k, v in vectors.items()]
    odd = [(200, None, 1, "x"), (201, [0.0] * 7 + [None], 1, "x"), (202, [float("nan")] + [0.0] * 7, 1, "x"), (203, [float("inf")] + [0.0] * 7, 1, "x"), (204, [1.0] * 4, 1, "x"), (205, [], 1, "x")]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int, code string")
    got = {r["vec_id"]: r for r in vector_codes.compress(frame, parts=4, entries=12, rounds=4).collect()}
    ordered = sorted(vectors)
    codes, errors, books = plain_codes([[math.floor(1024 * float(np.float32(x))) for x in vectors[k]] for k in ordered], 4, 12, 4)
    assert sorted(got) == ordered
    assert [got[k]["code"] for k in ordered] == codes
    assert [got[k]["error"] for k in ordered] == errors
    per = defaultdict(int)
    for k, e in zip(ordered, errors, strict=True):
        per[k % 3 if k % 5 else None] += e
    assert all(got[k]["label_error"] == per[k % 3 if k % 5 else None] for k in ordered)
    assert {r["codebooks_sha256"] for r in got.values()} == {hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()}


def test_search_from_any_start_finds_the_nearest():
    random.seed(2)
    rng = np.random.default_rng(2)
    for scale in (3, 1000, 1 << 26):  # ties, floats, whole numbers
        book = vector_codes.Codebook(rng.integers(-scale, scale, (40, 4)))
        x = rng.integers(-scale, scale, (500, 4))
        every = ((x[:, None, :] - book.entries[None]) ** 2).sum(axis=2)
        for start in (np.zeros(500, np.int64), rng.integers(0, 40, 500), every.argmin(axis=1)):
            code, error = book.search(x, start)
            assert (code == every.argmin(axis=1)).all() and (error == every.min(axis=1)).all()


def test_search_from_the_nearest_compares_few_entries():
    rng = np.random.default_rng(3)
    centres = rng.integers(-1000, 1000, (64, 4))
    x = np.repeat(centres, 20, axis=0) + rng.integers(-5, 6, (1280, 4))
    book = vector_codes.Codebook(centres)
    seen = []
    squares = book.squares
    book.squares = lambda a, b: seen.append(len(a) * len(b)) or squares(a, b)
    book.search(x, np.repeat(np.arange(64), 20))
    assert sum(seen) < 0.25 * len(x) * 64


def test_vector_codes_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_codes.compress(spark.createDataFrame([], schema)).collect() == []
    assert vector_codes.compress(spark.createDataFrame([(1, None, None)], schema)).collect() == []
    same = spark.createDataFrame([(1, [0.5] * 8, None)] * 3 + [(None, [0.25] * 8, None)], schema)
    got = vector_codes.compress(same).collect()
    assert sorted(r["code"] for r in got) == ["00000000"] * 3 + ["03030303"] and {r["label_error"] for r in got} == {0}
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [0.5] * 6, None)], schema))


def test_decoded_codes_are_the_entries(spark, data):
    frame = spark.read.parquet(f"{data}/embeddings.parquet")
    state, books = vector_codes.train(frame, rounds=1)
    code = F.lower(F.concat_ws("", F.transform("c", lambda x: F.lpad(F.hex(x), 2, "0"))))
    rows = vector_codes.decode(state.withColumn("code", code).limit(40), books).collect()
    assert all(sum((a - b) ** 2 for a, b in zip(r["v"], r["vector"], strict=True)) == r["e"] for r in rows)


# --- divergence --------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(0x41, 0x5B)}


def plain_audit(docs, least=3, top=200):
    counts, holders, groups = defaultdict(Counter), defaultdict(set), set()
    for key, text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for t in TERM.findall((text or "").translate(LOWER)):
            counts[lang, source][t] += 1
            holders[lang, t].add((source, key))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (of, t), h in holders.items() if of == lang and len(h) >= least]
        own = sorted(s for of, s in groups if of == lang)
        n = {s: {t: counts[lang, s][t] for t in kept} for s in own}
        shares = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p = {s: shares(n[s]) for s in own}
        q = shares({t: sum(n[s][t] for s in own) for t in kept})
        f = lambda a, b: (a - b) ** 2 // b
        for s in own:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in own if o != s]
            telling = [(t, f(p[s][t], q[t])) for t in kept if n[s][t] and p[s][t] > q[t]]
            for part, rows in (("pair", pairs), ("term", telling)):
                ranked = sorted(rows, key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, *r, i + 1) for i, r in enumerate(ranked if part == "pair" else ranked[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def audited():
    random.seed(8)
    words = [f"w{chr(97 + i)}" for i in range(12)] + ["Été", "ÉTÉ", "the", "The"]
    docs = [(i, " ".join(random.choices(words, weights=range(1, 17), k=random.randint(0, 30))), random.choice(["en", "de", None]), random.choice(["a", "a", "b", "c", None])) for i in range(80)]
    return [*docs, (80, None, "fr", "x"), (81, "", "fr", "y"), (82, "1 2 3", "fr", None), (None, LONG, "en", "a"), (None, LONG, "en", "a"), (84, "one", "en", "lonely")]


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_audit_equals_plain_python(spark, audited, broadcast_rows):
    frame = spark.createDataFrame([(*d, "z") for d in audited], "doc_id long, text string, lang string, source string, term string")
    got = divergence.audit(frame, top=4, broadcast_rows=broadcast_rows)
    assert sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in got.collect()) == plain_audit(audited, top=4)


def test_audit_does_not_depend_on_batches(spark, audited):
    """Runs cut by batches and pairs taken a few at a time give the same rows."""
    frame = spark.createDataFrame(audited, "doc_id long, text string, lang string, source string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = divergence.audit(frame)
        rows = sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert rows == plain_audit(audited)


def test_audit_of_nothing(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert divergence.audit(spark.createDataFrame([], schema)).collect() == []
    pair = divergence.audit(spark.createDataFrame([(1, None, None, None), (2, "a", None, "s")], schema)).collect()
    assert sorted((r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in pair) == [("", "pair", "s", 0, 1), ("s", "pair", "", 0, 1)]


# --- extraction --------------------------------------------------------------------------


def test_boilerplate_stays_boilerplate_however_deep():
    from rangeloom.llm import extract

    for depth in (1, 7, 8, 9, 300):
        page = '<body><div class="sidebar">' + "<form>" * depth + "<p>Sign up for the letter.</p>" + "</form>" * depth + "</div><p>An article of some words stands here.</p></body>"
        blocks = extract.parse(page)
        assert "bad" in blocks[0].flags and "form" in blocks[0].flags and not blocks[1].flags & {"bad", "form"}
