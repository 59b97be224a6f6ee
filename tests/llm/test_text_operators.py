"""Operators over documents against brute force."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import Counter

import pytest

from tessera.llm import bpe, chunking, external_bwt, jaccard_join, media_chunks, mixing, quality_rules, suffix_dedup

GAP = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def data(text):
    return (text or "").encode()


# Near duplicates --------------------------------------------------------------------------------


def shingles(text):
    w = GAP.findall((text or "").translate(UPPER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(rows):
    parent = {i: i for i, _ in rows}

    def top(a):
        while parent[a] != a:
            a = parent[a]
        return a

    sets = [(i, shingles(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return {i: top(i) for i in parent}


@pytest.mark.parametrize("light", [24, 2, 1])
def test_jaccard_join(docs, monkeypatch, light):
    """With all lists light, and with heavy ones down to pairs, the same components."""
    monkeypatch.setattr(jaccard_join, "LIGHT", light)
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None]
    got, want = by_id(jaccard_join.classes(docs)), components(dict(rows).items())
    assert {i: got[i]["component_id"] for i in want} == want
    assert {i: got[i]["n_shingles"] for i in want} == {i: len(shingles(t)) for i, t in rows}
    assert got[None]["component_id"] is None
    assert jaccard_join.classes(docs).count() == docs.count()


def test_jaccard_empty(nothing):
    assert jaccard_join.classes(nothing).count() == 0


def test_subsets_meet_just_the_linked():
    """For all sizes that may be small: sharing a subset is having the overlap."""
    for n in range(1, 8):
        for m in range(jaccard_join.least_partner(n), n * 5 // 4 + 1):
            need = jaccard_join.overlap(n, m)
            assert 100 * need >= 80 * (n + m - need) and 100 * (need - 1) < 80 * (n + m - need + 1)


# Suffix dedup -----------------------------------------------------------------------------------


def removed(rows):
    """Brute force over all strings of 50 bytes."""
    first = {}
    for i, t in rows:
        for k in range(len(data(t)) - 49):
            s = data(t)[k : k + 50]
            first[s] = min(first.get(s, i), i)
    out = {}
    for i, t in rows:
        b, gone = data(t), bytearray(len(data(t)))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot, block", [(100_000, 8000), (1, 3), (6, 1)])
def test_suffix_dedup(docs, monkeypatch, hot, block):
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", hot)
    monkeypatch.setattr(suffix_dedup, "BLOCK_SEGMENTS", block)
    rows = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    got = by_id(suffix_dedup.deduplicate(docs))
    assert {i: tuple(got[i])[1:5] for i in rows} == removed(sorted(rows.items()))
    assert got[None]["n_removed"] == 0 and suffix_dedup.deduplicate(docs).count() == docs.count()


def test_suffix_dedup_empty(nothing):
    assert suffix_dedup.deduplicate(nothing).count() == 0


def test_texts_of_one_document(spark):
    """Each text of a doc_id loses what it repeats itself, and nothing of the other's places."""
    passage = "a passage of more than fifty bytes that two documents share, word by word."
    rows = [(1, passage), (2, passage), (2, "something else that no other document has, and as long as the passage is"), (2, passage), (3, None), (None, passage)]
    found = suffix_dedup.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in found if r["doc_id"] is not None)
    n, m = len(passage), len(rows[2][1])
    assert got == sorted([(1, n, 0), (2, n, n), (2, m, 0), (2, n, n), (3, 0, 0)]) and len(found) == len(rows)


def test_whole_copies_are_settled_first(spark, monkeypatch):
    """Only the first document of a text is cut into segments; texts of one doc_id, null and short ones among them."""
    passage = "a passage of more than fifty bytes that some documents share, word by word, é."
    texts = {5: passage, 7: passage, 9: passage + passage, 11: "before it " + passage, 12: "x" * 49, 13: "x" * 49, 14: "y" * 50, 15: "y" * 50}
    asked = []
    monkeypatch.setattr(suffix_dedup, "_anchors", lambda known, f=suffix_dedup._anchors: asked.extend(known.collect()) or f(known))
    rows = [*texts.items(), (7, passage), (2, None)]
    got = by_id(suffix_dedup.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert {r["doc"] for r in asked} == {2, 5, 9, 11, 12, 13, 14}
    assert {i: tuple(got[i])[1:5] for i in got} == removed(sorted((texts | {2: None}).items()))
    more = [*rows, (7, "another text of document seven, which no other document has, not in part"), (7, None)]
    found = suffix_dedup.deduplicate(spark.createDataFrame(more, "doc_id bigint, text string")).collect()
    n = len(passage.encode())
    assert sorted((r["n_bytes"], r["n_removed"]) for r in found if r["doc_id"] == 7) == [(0, 0), (72, 0), (n, n), (n, n)]


def common(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("slice_", [1, 2, 3, 7, 1 << 20])
def test_transform_and_prefixes_in_files(tmp_path, monkeypatch, slice_):
    """Every entry of the files against sorted suffixes, with slices down to one entry."""
    import random

    import numpy as np

    monkeypatch.setattr(external_bwt, "SLICE", slice_)
    r = random.Random(slice_)
    for trial in range(12):
        words = [b"banana", b"ananas", b"", b"nab", b"banana"] if not trial else [bytes(r.choices(b"ab" if trial % 2 else b"abcde", k=r.randint(0, 14))) for _ in range(r.randint(1, 12))]
        length = np.array([len(w) for w in words])
        files = external_bwt.Files(str(tmp_path))
        external_bwt.build(files, np.frombuffer(b"".join(words) + b"\0", np.uint8), np.cumsum(length) - length, length, 0)
        symbols, prefixes = (np.concatenate(x) for x in zip(*files.read("symbol", "prefix"), strict=True))
        codes = files.codes()(len(symbols)).tolist()
        assert ((prefixes & external_bwt.CODED) != 0).all()
        symbols, prefixes = symbols.tolist(), (prefixes & ~external_bwt.CODED).tolist()
        place = [(c >> external_bwt.SIZE_BITS, c & external_bwt.MOST) for c in codes]
        suffixes = [words[i][len(words[i]) - j :] for i, j in place]
        assert suffixes == sorted(suffixes) and Counter(suffixes) == Counter(w[k:] for w in words for k in range(len(w) + 1))
        assert prefixes == [0] + [common(a, b) for a, b in zip(suffixes, suffixes[1:], strict=False)]
        assert symbols == [words[i][-1 - j] if j < len(words[i]) else external_bwt.END for i, j in place]
        files.close()
        files = external_bwt.Files(str(tmp_path))
        external_bwt.build(files, np.frombuffer(b"".join(words) + b"\0", np.uint8), np.cumsum(length) - length, length, 3)
        got = Counter()
        for string, size, group in external_bwt.groups(files, 3):
            for g in set(group.tolist()):
                own = [words[i][len(words[i]) - j :][:3] for i, j, k in zip(string, size, group, strict=True) if k == g]
                assert len(set(own)) == 1
                got[own[0]] += len(own)
        want = Counter(s[:3] for s in suffixes if len(s) >= 3)
        assert got == Counter({k: n for k, n in want.items() if n > 1})
        files.close()
    assert not list(tmp_path.iterdir())


def repeats(texts, doc):
    """The bits of the substrings of 50 bytes that a text of a smaller doc has, by their definition."""
    first = {}
    for t, d in zip(texts, doc, strict=True):
        for k in range(len(t) - 49):
            first[t[k : k + 50]] = min(first.get(t[k : k + 50], d), d)
    return [sum(1 << k for k in range(len(t) - 49) if first[t[k : k + 50]] < d) for t, d in zip(texts, doc, strict=True)]


@pytest.mark.parametrize("width, slice_, letters, n", [(1, 1 << 20, b"ab", 40), (2, 7, b"ab", 12), (5, 50, b"abc", 40), (10, 1, b"ab", 6), (10, 64, b"ab\xff", 60), (25, 30, b"ab", 40), (10, 1 << 20, bytes(range(200)), 2000), (10, 9000, bytes(range(200)), 2000)])
def test_symbols_of_several_bytes(tmp_path, monkeypatch, width, slice_, letters, n):
    """Repeated strings by symbols of any width, against the definition; the last two have more than 65,536 symbols."""
    import random

    import numpy as np

    monkeypatch.setattr(suffix_dedup, "WIDTH", width)
    monkeypatch.setattr(external_bwt, "SLICE", slice_)
    r = random.Random(width * slice_)
    common = [bytes(r.choices(letters, k=84)) for _ in range(1 + n // 12)]
    texts = set()
    while len(texts) < n:
        t = bytearray(r.choice(common) if r.random() < 0.5 else bytes(r.choices(letters, k=84)))
        t[r.randrange(84)] = r.choice(letters)
        texts.add(bytes(t[: r.randint(50, 84)] if len(letters) < 9 else t))
    doc = np.array([r.randrange(1 + n // 3) for _ in range(n)])
    texts = sorted(texts, key=lambda t: t[::-1])
    want = repeats(texts, doc.tolist())
    assert any(want) and suffix_dedup.repeated(texts, doc, str(tmp_path)).tolist() == want
    assert not list(tmp_path.iterdir())


def test_few_rounds_over_the_files(tmp_path, monkeypatch):
    """A round reads and writes all files, so their number is what a segment costs: 9 for 84 bytes, not 85."""
    import numpy as np

    rounds, write = [], external_bwt.Files.write
    monkeypatch.setattr(external_bwt.Files, "write", lambda self, slices: rounds.append(1) or write(self, slices))
    passage = bytes(range(33, 117))
    got = suffix_dedup.repeated([passage, passage[1:] + b"x"], np.array([1, 2]), str(tmp_path))
    assert got.tolist() == [0, (1 << 34) - 1] and len(rounds) <= 9


def test_segments_of_long_texts_agree(monkeypatch):
    """Slices of a long text give the windows of the whole."""
    import random

    import numpy as np

    text = bytes(random.Random(3).choices(b"abcde \n", k=3000))
    whole = suffix_dedup.segments(np.frombuffer(text, np.uint8), np.array([len(text)]))
    monkeypatch.setattr(suffix_dedup, "SLICE", 500)
    monkeypatch.setattr(suffix_dedup, "groups", lambda t: [(0, 1)])
    starts = []
    for _, part, ends, base in suffix_dedup._pieces([text]):
        _, _, begin, count, _ = suffix_dedup.segments(part, ends)
        starts += [base + b + k for b, c in zip(begin, count, strict=True) for k in range(c)]
    assert sorted(starts) == sorted(b + k for b, c in zip(whole[2], whole[3], strict=True) for k in range(c)) == list(range(len(text) - 49))


# Media chunks -----------------------------------------------------------------------------------


def test_media_chunks(docs):
    got = media_chunks.measure(docs)
    assert got.count() == docs.count()
    found = by_id(got)
    for r in docs.collect():
        b = data(r["text"])
        p = b + bytes(-len(b) % 64 if b else 64)
        x = found[r["doc_id"]]
        assert (x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert x["media_bytes"] == len(p) + 20 * len(chunking.chunks(p)) and x["feature"].startswith("mean=")


def test_media_empty(nothing):
    assert media_chunks.measure(nothing).count() == 0


def test_cuts_follow_content():
    import random

    r = random.Random(5)
    body = bytes(r.choices(range(97, 123), k=60_000))
    a, b = chunking.chunks(body), chunking.chunks(b"something else first " + body)
    assert b"".join(p for _, p in a) == body
    assert len({d for d, _ in a} & {d for d, _ in b}) >= len(a) - 3
    assert chunking.cuts(b"") == [] and max(len(p) for _, p in chunking.chunks(bytes(100_000))) <= chunking.MOST


def test_slices_cut_alike(monkeypatch):
    import random

    body = bytes(random.Random(7).choices(range(256), k=50_000))
    whole = chunking.cuts(body)
    monkeypatch.setattr(chunking, "SLICE", 1000)
    assert chunking.cuts(body) == whole


# Tokens -----------------------------------------------------------------------------------------


def test_bpe(docs):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    got = bpe.encode(docs, str(P.path("byte_bpe_50k.json")))
    assert got.count() == docs.count()
    found = by_id(got)
    for r in docs.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        x = found[r["doc_id"]]
        assert x["n_tokens"] == len(ids) and x["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert x["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_empty(nothing):
    import public_tokenizers as P

    assert bpe.encode(nothing, str(P.path("byte_bpe_50k.json"))).count() == 0


ODD_TEXTS = ["a  b\n\n c \t d", "<|endoftext|> x<|endoftext|>y", "it's we'll  don't ", "字 漢字\u3000かな\u00a0x \x1c y \x85 z", " lead", "trail ", "  ", "\n \n", "😀 😀 e\u0301 é", ""]


def test_chunks_join_exactly(texts):
    """With all chunks or some taken from elsewhere, cut anywhere, the ids are those of the whole."""
    import random

    import public_tokenizers as P
    from tokenizers import Tokenizer

    config = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()
    encoder, plain = bpe.Encoder(config), Tokenizer.from_str(config)
    r = random.Random(2)
    bits = ["the ", "été ", "字", "😀", "\n", "  ", "words", "<|endoftext|>", "'re", "'", "'l", "l", "\t", "123", "!!", "<|", "endoftext|>", "x" * 40, "é" * 30]
    random_texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 900))) for _ in range(150)]
    odd_runs = ["x" * 100_000, " " * 50_000 + "y", "\x1c\x85\u3000\u2028 a"]  # one piece each: nothing to reuse
    for text in odd_runs + ODD_TEXTS + random_texts + [texts[-1], "é字" * 20_000, "a é" + "é" * 9000 + " b " * 900]:
        taken = {name: encoder.marked(part).astype("<u4").tobytes() for _, parts in bpe.pieces(text, tuple(encoder.added)) for name, part in parts if r.random() < 0.8}
        ids = encoder.assembled(text, taken)
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids
        assert encoder.decode(ids) == text.encode() and encoder.ids(text).tolist() == ids.tolist()
    assert encoder.reused > 0.4 * (encoder.total - 150_000)


def test_every_character_is_split_alike():
    """All code points as letter, number, blank or sign: the ranks' splitter against the library."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    config = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()
    encoder, plain = bpe.Encoder(config), Tokenizer.from_str(config)
    for low in range(0, 0x110000, 512):
        text = "".join(f"a{c}a1{c}1 {c}\t{c}x  {c}!" for c in map(chr, range(low, low + 512)) if not "\ud800" <= c < "\ue000")
        assert encoder.ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids, hex(low)


def test_other_tokenizers_are_refused():
    import public_tokenizers as P

    with pytest.raises((ValueError, KeyError)):
        bpe.Encoder(open(P.path("word_bpe_49k.json"), encoding="utf-8").read())


# Quality rules ----------------------------------------------------------------------------------


def base_measures(text):
    w = GAP.findall(text or "")
    lines = [x for x in (text or "").split("\n") if GAP.search(x)]
    seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    again = {k + j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again))


def test_quality_rules(spark, docs):
    more = spark.createDataFrame([(9001, "a b c d e f g h " * 9), (9002, "x# y* |\nq\nq\n \nq <>"), (9003, "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8"), (9004, "k k k k k k k k k k")], "doc_id bigint, text string")
    all_docs = docs.select("doc_id", "text").unionByName(more)
    labels = spark.createDataFrame([(1 + 3 * k, 1, 0) for k in range(20, 40)] + [(None, 1, 0)], "doc_id bigint, quality int, toxic int")
    found = quality_rules.judge(all_docs, labels).collect()
    assert len(found) == all_docs.count()
    got = {r["doc_id"]: r for r in found}
    rows = [(r["doc_id"], r["text"]) for r in all_docs.collect()]
    import math

    import xxhash

    size = quality_rules.BUCKETS
    long_hash = lambda x, seed: xxhash.xxh64_intdigest(struct.pack("<Q", x), seed=seed)

    def buckets(t):
        h = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in GAP.findall(t or "")]
        return [x % size for x in h + [long_hash(b, long_hash(a, 42)) for a, b in zip(h, h[1:], strict=False)]]

    raw, good = Counter(), Counter()
    for i, t in rows:
        c = buckets(t)
        raw.update(c)
        if i in {1 + 3 * k for k in range(20, 40)}:
            good.update(c)
    s = quality_rules.SMOOTHING
    shift = math.log((sum(raw.values()) + s * size) / (sum(good.values()) + s * size))
    for i, t in rows:
        x, m = got[i], base_measures(t)
        assert tuple(x[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == m, i
        failed = m[0] < 20 or 100 * m[4] > 30 * m[0]
        grams = buckets(t)
        score = sum(math.log(good[b] + s) - math.log(raw[b] + s) + shift for b in grams) / len(grams) if grams else 0.0
        assert x["base_failed"] == failed and abs(x["score"] - score) < 2e-5
        assert x["kept"] == (not failed and x["score"] >= quality_rules.LEAST_RATIO)


def test_word_order_counts(spark):
    """Trusted words in another order have other pairs, and a lower score."""
    import random

    r = random.Random(1)
    line = [f"w{k}" for k in range(40)]
    mixed = [r.sample(line, 40) for _ in range(40)]
    rows = [(k, " ".join(line)) for k in range(40)] + [(100 + k, " ".join(m)) for k, m in enumerate(mixed)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(30)], "doc_id bigint, quality int, toxic int")
    got = {x["doc_id"]: x["score"] for x in quality_rules.judge(docs, labels).collect()}
    assert min(got[k] for k in range(40)) > max(got[100 + k] for k in range(40))


def test_quality_rules_empty(nothing, spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality_rules.judge(nothing, labels).count() == 0


# Mixing -----------------------------------------------------------------------------------------


def test_targets_are_capped_and_add_up():
    sizes = [("a", 10), ("b", 1000), ("c", 1000), (None, 500), ("d", 0)]
    plan = mixing.source_targets(sizes)
    assert [s for s, _, _ in plan] == ["a", "b", "c", "d", None]
    assert all(t <= 3 * n + 1e-9 for _, n, t in plan) and abs(sum(t for _, _, t in plan) - 2510) < 1e-6
    assert mixing.source_targets([("a", 0)])[0][2] == 0 and mixing.source_targets([]) == []


def test_mixing(docs):
    first = sorted(map(tuple, mixing.mix(docs, block_words=16).collect()), key=str)
    assert first == sorted(map(tuple, mixing.mix(docs.repartition(5), block_words=16).collect()), key=str)
    assert len(first) == docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    taken, target, size = Counter(), {}, Counter()
    for i, n, source, source_size, goal, got, _ in first:
        assert n == len(GAP.findall(texts[i] or "")) and 0 <= got <= 3 * n
        taken[source] += got
        size[source] += n
        target[source] = (source_size, goal)
    for s, (n, goal) in target.items():
        assert n == size[s] and abs(taken[s] - goal) <= 16 + 0.03 * goal
    assert abs(sum(g for _, g in target.values()) - sum(size.values())) < 1e-6


def test_shards_hold_the_blocks(docs):
    """Every slot holds one block of whole words, pieces make up the texts, and taken counts them."""
    found = mixing.shards(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), "lang", block_words=16, shard_slots=8).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    slots, words, pieces, uses = {}, Counter(), {}, {}
    for r in found:
        assert r["shard"] == r["slot"] // 8 and r["words"] == len(GAP.findall(r["text"])) > 0 and r["rest"]["lang"] == "en"
        slots.setdefault(r["slot"], []).append(r)
        words[r["doc_id"]] += r["words"]
        assert pieces.setdefault((r["doc_id"], r["block"]), r["text"]) == r["text"] in texts[r["doc_id"]]
    assert sorted(slots) == list(range(len(slots)))
    for rows in slots.values():
        rows.sort(key=lambda r: r["at"])
        assert len({(r["source"], r["block"]) for r in rows}) == 1 and sum(r["words"] for r in rows) <= 16
        assert [r["at"] for r in rows] == [sum(r["words"] for r in rows[:k]) for k in range(len(rows))]
        uses.setdefault(rows[0]["source"], Counter())[rows[0]["block"]] += 1
    assert all(max(n.values()) - min(n.values()) <= 1 for n in uses.values())
    whole = {i: "".join(pieces[k] for k in sorted(pieces) if k[0] == i) for i, _ in pieces}
    got = {r["doc_id"]: r for r in mixing.mix(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), block_words=16, shard_slots=8).collect()}
    assert {i: r["taken"] for i, r in got.items() if r["taken"]} == words
    full = [i for i, r in got.items() if r["size"] and r["target"] >= 1.1 * r["source_size"]]
    assert full and all(whole[i] == texts[i] for i in full)


def test_permutation_is_a_bijection(spark):
    from pyspark.sql import functions as F

    for count in (1, 2, 3, 5, 17, 250, 1009):
        rows = spark.range(count).select(mixing.permuted(F.col("id"), F.lit(count).cast("bigint"), F.lit(3)).alias("x")).collect()
        assert sorted(r["x"] for r in rows) == list(range(count))
        assert count < 17 or [r["x"] for r in rows] != list(range(count))


def test_shard_counts_are_random_and_totals_exact(spark):
    """Draws per shard spread as a multinomial's that is conditioned on its totals; sources of no slots too."""
    need = [(0, 40, 100), (1, 7, 0), (2, 500, 700), (3, 30, 90), (4, 10, 30)] + [(5 + k, 3, 2) for k in range(40)]
    rows = mixing._slots(spark, need, 50).collect()
    slots = sum(k for _, _, k in need)
    assert sorted(r["slot"] for r in rows) == list(range(slots)) and all(r["shard"] == r["slot"] // 50 for r in rows)
    uses = {i: Counter(r["block"] for r in rows if r["sid"] == i) for i, _, _ in need}
    for i, blocks, k in need:
        assert sum(uses[i].values()) == k and all(0 <= b < blocks for b in uses[i])
        assert not k or max(uses[i].values()) - min([uses[i][b] for b in range(blocks)]) <= 1
    per_shard = Counter(r["shard"] for r in rows if r["sid"] == 2)
    assert 25 < min(per_shard[s] for s in range(20)) < max(per_shard.values()) < 48


def test_mixing_empty(nothing):
    assert mixing.mix(nothing).count() == 0
