"""The corpus operators against brute force, on texts chosen to be awkward."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from pulsewright.llm import components, hashed_grams, language_id, pfair_mix, pii_bootstrap, quality_rules, setsketch_dedup, substring_trees, suffix_cover_dedup, token_files, weak_quality, winnow_decontam
from pulsewright.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, component long, row string"
BENCH = "item_id long, text string"


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(rng.choice(["w%d" % rng.randint(0, vocabulary), "the", "of", "and", "is", "été", "naïve"]) for _ in range(n))


def awkward(rng: random.Random) -> list[str | None]:
    base = prose(rng, 260)
    words = base.split()
    near = words[:100] + ["changed"] + words[101:]
    passage = prose(rng, 70)
    out: list[str | None] = [
        None, "", "   \n\t ", "one", "one two three four", "a b c d e", "A B C D E", base, base, base.upper(), " ".join(near), "\n".join(base.split(" ", 3)), "x " * 300, "worthless " * 120,
        passage + " " + prose(rng, 60), prose(rng, 40) + " " + passage, prose(rng, 55) + "  " + passage + "\n" + prose(rng, 50), "a" * 700, "é" * 400, "é" * 400 + "z", prose(rng, 4000), "line one here\nline one here\nother\n\nline one here",
        "  odd　spaces\u0085here", "###***" * 40, "mail a.b@c.de and 1.2.3.4 or 1.2.3.400, +1 (555) 123-4567 4111 1111 1111 1111", "MAIL x@y.zz " * 30, "9" * 5000, "😀 emoji text 😀😀 with words", "start <|endoftext|>\n<|endoftext|><|endoftext|>  end <|endoftext|> x<|endoftext|",
    ]
    for k in range(12):
        out.append(" ".join(w if rng.random() > 0.03 * k else "m%d" % rng.randint(0, 999) for w in words))
    return out


@pytest.fixture(scope="module")
def texts():
    return awkward(random.Random(4))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3 + 1, t, ("en", "fr", None)[i % 3], ("hot", "hot", "b", None)[i % 4], len(t or ""), "x", 5, None) for i, t in enumerate(texts)]
    rows.append(rows[7])  # a repeated row
    rows.append((None, texts[7], "en", "b", 1, None, None, "r"))  # no id
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def source(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_token_files(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    got = {r.doc_id: r for r in token_files.digest(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]), tokenizer_path()).collect()}
    start = 0
    for i, text in sorted({d for d in source(docs) if d[0] is not None}):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        start += len(ids)
    assert token_files.digest(docs, tokenizer_path()).count() == docs.count()
    assert token_files.digest(empty, tokenizer_path()).count() == 0


def test_token_sequences_are_random_access(docs):
    shards = token_files.write_tokens(docs, tokenizer_path(), length=64)
    for s in shards:
        reader, side = token_files.open_shard(s["path"])
        total = 0
        for k in range(reader.num_record_batches):
            b = reader.get_batch(k)
            assert b.schema.field("tokens").type.list_size == 64
            total += int(b.column("mask").flatten().to_numpy(zero_copy_only=False).sum())
            b.column("tokens").flatten().to_numpy(zero_copy_only=True)
        assert total == s["n_tokens"] == sum(side.column("n_tokens").to_pylist())


def test_pieces_encode_like_whole_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from pulsewright.llm import textkit as K

    t = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "\n\n", "\t", "a", "b", "é", "×", "…", " ", "　", "\u0085", "1", ".", "***", "'s", "'", "<|endoftext|>", "<|endoftext|>", "<|endoftext", "|>", "😀", "中", "x y", "À", "ñ "]
    rows = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for i, j, data, offsets in K.chunks(pa.array(rows)):
        ids, cut = token_files.encode(data, offsets, tokenizer_path())
        for r in range(j - i):
            assert ids[cut[r] : cut[r + 1]].tolist() == [*t.encode(rows[i + r], add_special_tokens=False).ids, 0]


def test_empty_rows_beside_added_tokens_encode_like_whole_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from pulsewright.llm import textkit as K

    t = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(12)
    parts = ["<|endoftext|>", "<|endoftext|>", "a", "b c", " ", "\n"]
    chunks = [["", "<|endoftext|>b"], ["", "a<|endoftext|>"], [None, "<|endoftext|>"], ["<|endoftext|>", ""], [None, ""]]
    chunks += [[rng.choice([None, "", "".join(rng.choice(parts) for _ in range(rng.randint(0, 3)))]) for _ in range(rng.randint(1, 5))] for _ in range(2000)]
    for rows in chunks:
        for i, j, data, offsets in K.chunks(pa.array(rows, pa.string())):
            ids, cut = token_files.encode(data, offsets, tokenizer_path())
            for r in range(j - i):
                assert ids[cut[r] : cut[r + 1]].tolist() == [*t.encode(rows[i + r] or "", add_special_tokens=False).ids, 0], rows


def test_token_files_of_nulls_beside_added_tokens(spark):
    rows = spark.createDataFrame([(1, None), (2, "<|endoftext|>b"), (3, "c d"), (4, "")], "doc_id long, text string").coalesce(1)
    assert [(r.doc_id, r.n_tokens) for r in token_files.digest(rows, tokenizer_path()).orderBy("doc_id").collect()] == [(1, 1), (2, 3), (3, 3), (4, 1)]


def flows(blocks, weights):
    """Exact flows of each source at the end of every slot, by going from one exhaustion to the next."""
    weights = {s: Fraction(repr(float(w))) for s, w in weights.items() if blocks[s]}
    at, given, out = Fraction(0), dict.fromkeys(weights, Fraction(0)), []
    for own in ({s for s, w in weights.items() if w > 0}, {s for s, w in weights.items() if w == 0}):
        left = set(own)
        rate = {s: weights[s] or Fraction(1) for s in own}
        while left:
            total = sum(rate[s] for s in left)
            step = min(min((blocks[s] - given[s]) * total / rate[s] for s in left), len(out) + 1 - at)
            for s in left:
                given[s] += step * rate[s] / total
            at += step
            left = {s for s in left if given[s] < blocks[s]}
            if at == len(out) + 1:
                out.append(dict(given))
    return out


def check_schedule(blocks, weights):
    rows = list(pfair_mix.schedule(blocks, weights))
    assert sorted((r[0], r[1]) for r in rows) == sorted((s, j) for s, n in blocks.items() for j in range(n))
    given, worst = Counter(), 0
    for t, ((s, j, slot, release, deadline, _), flow) in enumerate(zip(rows, flows(blocks, weights), strict=True)):
        assert slot == t and j == given[s] and release <= t < deadline
        given[s] += 1
        worst = max(worst, *(abs(given[o] - x) for o, x in flow.items()))
    assert worst < 1
    return rows


def test_pfair_deviation_is_below_one_block_over_the_whole_run():
    check_schedule({"a": 37, "b": 5, "c": 1, "d": 0}, {"a": 1.0, "b": 2.0, "c": 0.1, "d": 1.0})
    check_schedule({"x": 3}, {"x": 0.0})
    rng = random.Random(17)
    for k in (5, 20, 60):
        for _ in range(4):
            check_schedule({f"s{i:02d}": rng.randint(1, 60) for i in range(k)}, {f"s{i:02d}": rng.choice([rng.random(), rng.random() ** 4, 1e-6, 5]) for i in range(k)})
    check_schedule({"hot": 700, **{f"s{i:03d}": 7 for i in range(100)}}, {"hot": 0.5, **{f"s{i:03d}": 0.005 for i in range(100)}})


def test_pfair_windows_against_the_definition():
    """A block's release and deadline are where its flow begins and ends, rounded outwards."""
    blocks, weights = {"a": 30, "b": 11, "c": 4, "z": 3}, {"a": 1 / 3, "b": 0.7, "c": 0.01, "z": 0.0}
    flow = [dict.fromkeys(blocks, 0), *flows(blocks, weights)]
    for s, j, _, release, deadline, _ in pfair_mix.schedule(blocks, weights):
        assert release == max(t for t, f in enumerate(flow) if f[s] <= j and (t == 0 or s != "z" or t >= 45)) and deadline == min(t for t, f in enumerate(flow) if f[s] >= j + 1)


def test_pfair_sources_without_weight_come_last():
    rows = check_schedule({"a": 5, "b": 3, "c": 2, "d": 3}, {"a": 0.7, "b": 0.0, "c": 0.1**9, "d": 0.0})
    assert {r[0] for r in rows[:7]} == {"a", "c"} and {r[0] for r in rows[7:]} == {"b", "d"}


def test_pfair_blocks_grow_so_that_their_number_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(pfair_mix, "BLOCKS", 10)
    got = pfair_mix.digest(spark.range(1000).selectExpr("id as doc_id", "'x' as source")).collect()
    assert Counter(r.block for r in got) == dict.fromkeys(range(10), 100) and sorted((r.slot, r.place) for r in got) == [(b, p) for b in range(10) for p in range(100)]


def test_mix_keeps_every_row(docs, empty):
    out = pfair_mix.digest(docs, {"hot": 0.6, "b": 0.3, None: 0.1})
    assert out.count() == docs.count()
    assert collected(out, "doc_id", "source") == collected(docs, "doc_id", "source")
    mixed = pfair_mix.mix(docs)
    assert mixed.columns == docs.columns
    assert collected(mixed, *docs.columns) == collected(docs, *docs.columns)
    assert pfair_mix.mix(empty).count() == pfair_mix.digest(empty).count() == 0


def test_pfair_places_against_the_definition(spark):
    """Slot, release and deadline of every document, for weights that no short period repeats."""
    rng = random.Random(21)
    names = ["a"] * 900 + ["b"] * 500 + ["c"] * 300 + ["tiny"] * 40 + [None] * 60
    rng.shuffle(names)
    weights = {"a": 1 / 3, "b": 1 / 3, "c": 0.3, "tiny": 1e-6, None: 0.03}
    rows = [(None if i % 50 == 0 else i // 2, s, f"t{i}") for i, s in enumerate(names)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as slot", "2 as _src", "3 as _bucket", "4 as row")
    out = pfair_mix.place(df, weights, block=4)
    assert [c for c in out.columns if c not in pfair_mix.NEW] == [c for c in df.columns if c != "slot"]
    got = out.collect()
    assert sorted(r.text for r in got) == sorted(t for *_, t in rows)
    blocks = defaultdict(list)
    for r in got:
        blocks[r.source, r.block].append(r)
    sizes = Counter(names)
    assert {k: sorted(r.place for r in v) for k, v in blocks.items()} == {(s, b): list(range(min(4, n - 4 * b))) for s, n in sizes.items() for b in range(-(-n // 4))}
    head = {k: v[0] for k, v in blocks.items()}
    assert all(len({(r.slot, r.release, r.deadline, r.phase) for r in v}) == 1 for v in blocks.values())
    assert sorted(r.slot for r in head.values()) == list(range(len(head)))
    listed = {(s if s != "null" else None, j): w for s, j, *w in check_schedule({s or "null": -(-n // 4) for s, n in sizes.items()}, {s or "null": w for s, w in weights.items()})}
    assert {k: (r.release, r.deadline) for k, r in head.items()} == {k: (w[1], w[2]) for k, w in listed.items()}
    assert all(r.release <= r.slot < r.deadline for r in head.values())
    again = {r.text: (r.slot, r.place) for r in pfair_mix.place(df.repartition(7), weights, block=4).collect()}
    assert again == {r.text: (r.slot, r.place) for r in got}


def test_decontamination(spark, docs, empty, texts):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = [(10, " ".join(texts[7].split()[20:45])), (9, "one two three four"), (11, "EMOJI text"), (8, None), (7, "..."), (None, texts[7]), (6, prose(random.Random(99), 30)), (5, " ".join(texts[7].split()[22:40])), (5, "b c")]
    bench = spark.createDataFrame(items, BENCH)
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        if i is not None and w:
            m = min(10, len(w))
            for p in range(len(w) - m + 1):
                wins[tuple(w[p : p + m])].add(str(i))
    want = []
    for i, t in source(docs):
        w, hit, ids = words(t), set(), set()
        for m in {len(k) for k in wins}:
            for p in range(len(w) - m + 1):
                if (k := tuple(w[p : p + m])) in wins:
                    hit |= set(range(p, p + m))
                    ids |= wins[k]
        want.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert collected(winnow_decontam.digest(docs, bench), *cols) == sorted(want, key=repr)
    split = winnow_decontam.mark(docs.select("doc_id", "text"), bench, block=7)  # several blocks
    assert sorted((r.doc_id or -1, len(r.hits), len(r.items)) for r in split.collect()) == sorted((x[0] or -1, x[2], x[3]) for x in want)
    clean = winnow_decontam.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not x[-1] for x in want)
    assert winnow_decontam.digest(docs, spark.createDataFrame([], BENCH)).filter("contaminated").count() == 0
    assert winnow_decontam.digest(empty, bench).count() == 0


def test_language_id(spark, empty):
    rng = random.Random(8)
    vocab = {"aa": ["the", "house", "with", "thing"], "bb": ["être", "maison", "où", "ça"], "cc": ["straße", "über", "haus", "nicht"]}
    rows = [(i, " ".join(rng.choice(vocab[k]) for _ in range(rng.randint(3, 60))), k) for i in range(600) for k in [sorted(vocab)[i % 3]]]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !!", None), (None, "the house", None), (1003, "the thing with the house " * 3000, None), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'s' as source", "1 as score", "2 as row")
    got = language_id.digest(df).collect()
    assert len(got) == len(rows)
    lang = dict((i, k) for i, _, k in rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        if r.doc_id in (1000, 1001, 1002):
            assert r.lang_pred == "und" and r.score == 0 and r.rejected
    own = [r for r in got if r.doc_id is not None and r.doc_id < 1000 and r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in own) >= 0.98 * len(own)
    assert {r.lang_pred for r in got if r.doc_id in (None, 1003)} == {"aa"}
    kept = language_id.keep_known(df)
    assert kept.columns == df.columns
    assert set(language_id.digest(empty.select("doc_id", "text", "lang")).collect()) == set()
    nothing = language_id.digest(df.selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_language_id_rejects_what_it_never_saw(spark):
    rng = random.Random(8)
    vocab = {"aa": ["the", "house", "with", "thing", "other"], "bb": ["être", "maison", "où", "ça", "fait"], "cc": ["straße", "über", "haus", "nicht", "und"], "zz": ["mwanzo", "kupika", "jambo", "njia", "ukweli"]}
    rows = [(i, " ".join(rng.choice(vocab[k]) for _ in range(rng.randint(40, 200))), k if k in ("aa", "bb") else None) for i in range(800) for k in [sorted(vocab)[i % 4]] if k != "cc"]
    rows += [(2000 + i, " ".join(rng.choice(vocab["cc"]) for _ in range(4000)), "cc") for i in range(120)]  # a language of long texts only
    got = {r.doc_id: r for r in language_id.digest(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    strange = [got[i].rejected for i, _, k in rows if k is None]
    known = [got[i].rejected for i, _, k in rows if k]
    assert np.mean(strange) > 0.95 and np.mean(known) < 0.01
    assert {got[i].lang_pred for i, _, k in rows if k == "cc"} == {"cc"}


def check_substring_bytes(docs, most):
    rows = source(docs)
    seen = Counter()
    for _, t in rows:
        b = t.encode()
        seen.update(b[p : p + 200] for p in range(len(b) - 199))
    want = []
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        want.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    assert collected(suffix_cover_dedup.digest(docs, most=most), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)


def check_substring_words(docs, most):
    rows = source(docs)
    split = lambda t: [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    least: dict = {}
    for i, t in rows:
        w = split(t)
        for p in range(len(w) - 49):
            k = tuple(w[p : p + 50])
            if i is not None:
                least[k] = min(i, least.get(k, i))
    want = []
    for i, t in rows:
        w = split(t)
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - 49):
            if i is not None and least[tuple(w[p : p + 50])] < i:
                gone[p : p + 50] = True
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((i, len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    assert collected(substring_trees.digest(docs, most=most), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)


@pytest.mark.parametrize("most", [2, 500])
def test_substring_bytes(docs, empty, most):
    check_substring_bytes(docs, most)
    out = suffix_cover_dedup.dedup_bytes(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert suffix_cover_dedup.digest(empty).count() == 0


@pytest.mark.parametrize("most", [2, 500])
def test_substring_words(docs, empty, most):
    check_substring_words(docs, most)
    out = substring_trees.dedup_substrings(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert substring_trees.digest(empty).count() == 0


def test_hot_passages_are_found(spark):
    """One line in every document, before and behind different words, and a periodic text: groups that must be split."""
    rng = random.Random(5)
    line = prose(rng, 90)
    texts = [prose(rng, rng.randint(0, 50)) + " " + line[rng.choice([0, 0, 40]) :] + " " + prose(rng, rng.randint(0, 50)) for _ in range(60)]
    texts += ["ab " * 150, "xyz " * 90 + "ab " * 100, line[:300], line[5:210], line + line]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for most in (4,):
        check_substring_bytes(df, most)
        check_substring_words(df, most)


def test_quality_rules(docs, empty):
    for r in quality_rules.digest(docs).collect():
        t = next(t for i, t in source(docs) if i == r.doc_id)
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        rep = {q for p in range(len(w) - 2) if tri[tuple(w[p : p + 3])] > 1 for q in (p, p + 1, p + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep)), t[:60]
        assert r.base_failed == (len(w) < 50 or 100 * len(rep) > 50 * len(w)) and (not r.kept or not r.base_failed)
    assert quality_rules.keep_good(docs).columns == docs.columns
    assert quality_rules.digest(empty).count() == 0


def check_near_duplicates(docs):
    def shingles(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if x]
        return {tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    rows = [(i, shingles(t)) for i, t in source(docs)]
    parent = {i: i for i, _ in rows if i is not None}

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for i, a in rows:
        for j, b in rows:
            if i is not None and j is not None and i < j and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    want = [(i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in rows]
    assert collected(setsketch_dedup.digest(docs), "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=repr)
    out = setsketch_dedup.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {x[0] for x in want if x[3]}


def test_near_duplicates_leave_one_row_of_an_id(spark):
    rng = random.Random(8)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(1, a), (1, a), (1, a), (2, a), (3, b), (4, b), (4, b), (5, c), (None, c), (None, c), (6, None), (6, " \n"), (7, "\t"), (8, "one"), (8, "one")]
    out = setsketch_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert collected(out, "doc_id", "text") == sorted([(1, a), (3, b), (5, c), (None, c), (None, c), (6, None), (6, " \n"), (7, "\t"), (8, "one")], key=repr)


def test_near_duplicates(docs, empty):
    check_near_duplicates(docs)
    assert setsketch_dedup.digest(empty).count() == 0


def test_one_id_with_several_texts(spark):
    """All links of an id count, whichever of its texts they come from."""
    rng = random.Random(14)
    rows, links = [], {}
    for k in range(40):
        a, b = (prose(rng, 80).split() for _ in range(2))
        c, d = [*a[:40], "c", *a[41:]], [*b[:40], "d", *b[41:]]
        base = 10 * k
        rows += [(base, " ".join(a)), (base, " ".join(b)), (base + 1, " ".join(c)), (base + 2, " ".join(d)), (base + 3, prose(rng, 80))]
        links |= {base: base, base + 1: base, base + 2: base, base + 3: base + 3}
    got = setsketch_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(r.component_id == links[r.doc_id] for r in got)


def test_hubs_that_fail_do_not_lose_links(spark):
    """Copies of one base that are far from the least of them, and from each other, but near the base."""
    rng = random.Random(3)
    base = ["b%d" % i for i in range(300)]
    rows = []
    for i in range(60):
        rate = 0.2 if i < 10 else 0.0 if i == 40 else 0.02
        rows.append((i, " ".join(w if rng.random() >= rate else "n%d_%d" % (i, k) for k, w in enumerate(base))))
    check_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(5)
    for j in (0.2, 0.5, 0.75, 0.95):
        n = 600
        both = int(2 * n * j / (1 + j))
        pool = rng.integers(1, 1 << 62, 2 * n, dtype=np.uint64)
        a, b = pool[:n], np.concatenate([pool[:both], pool[n : 2 * n - both]])
        r = setsketch_dedup.registers(np.concatenate([a, b]), np.array([0, n, 2 * n]))
        got = setsketch_dedup.joint_estimate(r[:1], r[1:], np.array([float(n)]), np.array([float(n)]))[0]
        assert abs(got - j) < 0.16
        merged = setsketch_dedup.registers(np.union1d(a, b), np.array([0, len(np.union1d(a, b))]))
        assert (merged[0] == np.maximum(r[0], r[1])).all()


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 4)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent: dict[int, int] = {}

    def find(i):
        parent.setdefault(i, i)
        return i if parent[i] == i else find(parent[i])

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def base_spans(t):
    def luhn(d):
        return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))), "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }
    return {k: [m.span() for m in re.finditer(rx, t) if ok(m.group())] for k, (rx, ok) in kinds.items()}


def test_pii_base(docs, empty):
    want = []
    for i, t in source(docs):
        found = base_spans(t)
        text = ",".join(f"{k}:{s}:{e}" for k, x in found.items() for s, e in x)
        want.append((i, *(len(x) for x in found.values()), hashlib.sha256(text.encode()).hexdigest()))
    got = pii_bootstrap.digest(docs)
    assert collected(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want, key=repr)
    assert pii_bootstrap.digest(empty).count() == 0


def brute_pii(rows):
    """{place in rows: spans found by the bootstrap}, from the definition."""
    import regex

    word, gap = r"[\p{L}\p{N}_]+", r"[^\p{L}\p{N}_]{1,6}"
    seen = []  # row, start, end, instance, seed, patterns, is a run
    for r, (_, t) in enumerate(rows):
        t = t or ""
        base = base_spans(t)
        taken = [x for v in base.values() for x in v]
        for kind, rx in [*pii_bootstrap.PATTERNS.items(), ("run", pii_bootstrap.RUN)]:
            last = 0
            for m in regex.finditer(rx, t):
                s, e = m.span()
                prev, last = last, s
                if kind == "run":
                    e = s + len(m[0].rstrip(".,%+/-"))
                    if e == s or any(a < e and s < b for a, b in taken):
                        continue
                elif (s, e) not in base[kind]:
                    continue
                left = re.sub(r"[ \t\n\x0b\f\r]+", " ", re.sub("[0-9]", "0", t[max(prev, s - 48) : s].lower()))
                own = []
                if (one := regex.search(f"{word}{gap}$", left)) and regex.search(r"[^\p{L}\p{N}_ ]", one[0]):
                    own.append(("one", one[0], t[m.end() : m.end() + 1]))
                if two := regex.search(word + gap + word + gap + "$", left):
                    own.append(("two", two[0]))
                seen.append((r, s, e, t[s:e], kind != "run" or bool(re.search(pii_bootstrap.KEY, t[s:e])), own, kind == "run"))
    edges = defaultdict(set)
    seeds = {}
    for *_, what, seed, own, _ in seen:
        seeds[what] = seeds.get(what, False) or seed
        for x in own:
            edges[x].add(what)
    scores: dict = {}
    for _ in range(pii_bootstrap.ROUNDS):
        own = {x: [1.0 if seeds[w] else scores.get(w, 0.0) for w in ws] for x, ws in edges.items()}
        good = {x: sum(v) / len(v) for x, v in own.items() if sum(v) >= pii_bootstrap.SUPPORT and sum(v) / len(v) >= pii_bootstrap.CONFIDENCE}
        scores = {}
        for x, conf in good.items():
            for w in edges[x]:
                scores[w] = 1 - (1 - scores.get(w, 0.0)) * max(1 - conf, 1e-9)
    out = defaultdict(set)
    for r, s, e, what, _, own, is_run in seen:
        if is_run and scores.get(what, 0) >= pii_bootstrap.CONFIDENCE and any(x in good for x in own):
            out[r].add((s, e))
    return out


def test_pii_bootstrap(spark, texts):
    """Against the definition; generations: e-mail addresses teach `account is`, what follows it teaches `(ref`, and that finds more."""
    rng = random.Random(11)
    rows = [(i, f"some words then my account is user{i}@mail.com and more") for i in range(800)]
    rows += [(1000 + i, f"other text but my account is xk-99{i:03d}-b here") for i in range(40)]
    rows += [(2000 + i, f"{prose(rng, 5)} (ref: xk-99{i:03d}-b) {prose(rng, 5)}") for i in range(40)] + [(2100, "see (ref: new-77) and (ref: new-78)")]
    rows += [(3000 + i, f'x token = "{hashlib.sha1(bytes([i])).hexdigest()}" y') for i in range(15)] + [(3020, 'a token = "s3cr3t" b'), (3021, f"free {hashlib.sha1(b'z').hexdigest()} key")]
    rows += [(4000, "a room 12 of the house"), (4001, "the year 1999 was fine"), (4002, " ".join(map(str, range(20_000))))]
    rows += [(5000 + k, t) for k, t in enumerate(texts)] + [(None, rows[0][1]), rows[803], (3000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = brute_pii(rows)
    got = pii_bootstrap.digest(df.selectExpr("*", "1 as uid", "2 as found", "'x' as spans")).collect()
    listed = sorted((r.doc_id or -1, tuple(re.findall(r"found:[0-9]+:[0-9]+", r.spans)), r.n_found) for r in got)
    assert listed == sorted((i or -1, tuple(f"found:{s}:{e}" for s, e in sorted(want[k])), len(want[k])) for k, (i, _) in enumerate(rows))
    found = {i: n for i, _, n in listed}
    assert found[1000] == found[2004] == found[3001] == found[3020] == 1 and found[2100] == 2
    assert not any(found[i] for i in (3021, 4000, 4001, 4002))


def test_weak_quality(spark, empty):
    rng = random.Random(9)
    good = [(i, ". ".join(prose(rng, 12) for _ in range(12))) for i in range(300)]
    bad = [(1000 + i, " ".join(w + rng.choice(["***", "&&&"]) for w in prose(rng, 90).split())) for i in range(60)] + [(2000 + i, "buy now " * 80) for i in range(60)]
    rows = [*good, *bad, (5000, None), (5001, ""), (None, good[0][1]), good[3]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = weak_quality.digest(df).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id: r.kept for r in got}
    assert sum(kept[i] for i, _ in good) >= 0.97 * len(good) and sum(kept[i] for i, _ in bad) <= 0.05 * len(bad)
    assert not kept[5000] and not kept[5001]
    assert weak_quality.digest(empty).count() == 0
    out = weak_quality.keep_good(df.selectExpr("*", "1 as rid", "2 as score", "3 as pattern"))
    assert out.columns == ["doc_id", "text", "rid", "score", "pattern"]
    assert collected(out, "doc_id") == sorted(((r.doc_id,) for r in got if r.kept), key=repr)


def test_label_model_learns_who_is_right():
    rng = np.random.default_rng(1)
    y = rng.random(20000) < 0.8
    rates = [0.95, 0.9, 0.85, 0.9, 0.6, 0.9]
    code = np.zeros(len(y), int)
    for k, r in enumerate(rates):
        right = rng.random(len(y)) < r
        vote = np.where(rng.random(len(y)) < 0.3, 0, np.where(right == y, 2, 1))
        code += vote * 3**k
    post = weak_quality.label_model(dict(Counter(code.tolist())))
    guess = np.array([post[c] for c in code.tolist()]) > 0.5
    assert (guess == y).mean() > 0.95
    assert weak_quality.label_model({}) == {}


def test_votes_posteriors_and_scores_against_plain_loops(spark):
    """Votes by Python's own measures, posteriors by expectation-maximisation over documents, scores by one mean a text."""
    rng = random.Random(31)
    texts = [". ".join(prose(rng, rng.randint(3, 30)) for _ in range(rng.randint(1, 9))) for _ in range(120)]
    texts += ["\n".join(rng.choice(["same line", "other line", "THE LOUD LINE"]) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    texts += [" ".join(w + rng.choice(["", "##", "&"]) for w in prose(rng, 60).split()) for _ in range(60)] + ["", " \n", None, "x", "ab"]
    got = weak_quality.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    measured = quality_rules.measures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    digits = {}
    for r in measured:
        t = r.text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        if not words:
            continue
        chars, lines = sum(map(len, words)), [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        inside = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
        assert r.n_words == len(words) and r.n_lines == len(lines)
        values = [
            (len(re.findall(r"[#*$%&|<>]", t)) / len(words), ">", 0.1, 0.02), (len(inside) / len(words), ">", 0.5, 0.1), (r.n_stop_words / len(words), "<", 0.06, 0.12),
            ((len(lines) - len(set(lines))) / len(lines) if len(lines) >= 4 else None, ">", 0.5, 0.1), (chars / len(words), ">", 6.5, 6.0), (len(re.findall("[A-Z]", t)) / chars, ">", 0.3, 0.1),
        ]
        vote = lambda v, sign, bad, good: 0 if v is None else 1 if (v > bad if sign == ">" else v < bad) else 2 if (v < good if sign == ">" else v > good) else 0
        digits[r.doc_id] = [vote(*x) for x in values]
    post = {i: min(0.95, max(0.05, 0.5 + 0.2 * (d.count(2) - 1.5 * d.count(1)))) for i, d in digits.items()}
    for _ in range(100):
        rates = []
        for weight in (lambda p: 1 - p, lambda p: p):
            each = []
            for k in range(6):
                n = [0.5 + sum(weight(post[i]) for i, d in digits.items() if d[k] == v) for v in range(3)]
                each.append([np.log(x / sum(n)) for x in n])
            rates.append(each)
        prior = min(0.99, max(0.01, sum(post.values()) / len(post)))
        z = {i: np.log(prior / (1 - prior)) + sum(rates[1][k][v] - rates[0][k][v] for k, v in enumerate(d)) for i, d in digits.items()}
        post = {i: 1 / (1 + np.exp(-max(-30.0, min(30.0, x)))) for i, x in z.items()}
    for r in got:
        assert abs(r.posterior - post.get(r.doc_id, 0.0)) < 1e-6, r.doc_id
    rid = {r.doc_id: r.h for r in spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "xxhash64(coalesce(text, '')) as h").collect()}
    own = {rid[i]: (texts[i].encode(), post[i]) for i in digits if len(texts[i].encode()) >= 4}
    order = sorted(own)
    pool = np.concatenate([hashed_grams.pools(np.frombuffer(own[h][0], np.uint8), np.array([0, len(own[h][0])]), np.array([h]).view(np.uint64), hashed_grams.SHAPES) for h in order])
    p = np.array([own[h][1] for h in order])
    model = hashed_grams.train(pool, np.stack([1 - p, p], 1), ["bad", "good"])
    for r in got:
        b = hashed_grams.SHAPES[np.frombuffer((texts[r.doc_id] or "").encode(), np.uint8)]
        runs = [int(x) for n in hashed_grams.GRAMS for x in hashed_grams.buckets(b, n)]
        logit = (model.table[runs].astype(float).mean(0) if runs else 0) + model.bias
        want = 0.0 if r.doc_id not in digits else 1 / (1 + np.exp(logit[0] - logit[1]))
        assert abs(r.score - want) < 1e-3 and r.kept == (r.score >= 0.5)


def test_training_features_come_from_whole_texts():
    text = np.frombuffer(b"ab" * 60_000 + b"qz" * 60_000, np.uint8)
    got = hashed_grams.pools(text, np.array([0, len(text)]), np.array([5], np.uint64), hashed_grams.LETTERS)[0]
    for g, n in enumerate(hashed_grams.GRAMS):
        all_of = Counter(hashed_grams.buckets(hashed_grams.LETTERS[text], n).tolist())
        assert set(got[g].tolist()) <= set(all_of)
        half = set(hashed_grams.buckets(text[:1000], n).tolist())
        assert 0.4 < np.mean([x in half for x in got[g].tolist()]) < 0.6
    assert not hashed_grams.pools(np.frombuffer(b"abc", np.uint8), np.array([0, 3]), np.array([1], np.uint64), hashed_grams.LETTERS).any()


def test_training_is_deterministic():
    texts = [b"abc def", b"xyz uvw", b"abc abc", b"xyz xyz"] * 5
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    y = np.eye(2)[[0, 1, 0, 1] * 5]
    a, b = (hashed_grams.train(hashed_grams.pools(data, at, np.arange(20), hashed_grams.LETTERS), y, ["a", "x"]) for _ in range(2))
    assert (a.table == b.table).all()
