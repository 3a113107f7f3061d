"""Spelling variants, sentence pieces and the Merkle manifest against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sightline.llm import merkle, sentence_pieces, spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# Merkle manifest


def plain_manifest(rows) -> list[tuple]:
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return sha("".join(map(field, (*r[:4], text))))

    def tree(digests):
        ways, level = [[] for _ in digests], [(d, [i]) for i, d in enumerate(digests)]
        while len(level) > 1:
            above = []
            for k in range(0, len(level), 8):
                run = [d for d, _ in level[k : k + 8]]
                for j, (_, below) in enumerate(level[k : k + 8]):
                    for i in below:
                        ways[i].append((j, run))
                above.append((sha("".join(run)), [i for _, below in level[k : k + 8] for i in below]))
            level = above
        return level[0][0], ways

    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = [tree([x[2] for x in sorted(langs[k], key=lambda x: x[:3])]) for k in order]
    root, above = tree([t[0] for t in trees])
    out = []
    for lang, (subroot, ways), over in zip(order, trees, above):
        for (_, _, digest, r), way in zip(sorted(langs[lang], key=lambda x: x[:3]), ways):
            hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            now, siblings = leaf(r, r[4].translate(LOW) if hit else r[4]), ""
            for j, run in way + over:
                siblings += "".join(run[:j] + run[j + 1 :])
                now = sha("".join([*run[:j], now, *run[j + 1 :]]))
            out.append((r[0], digest, subroot, root, sha(siblings), now, now == root))
    return out


def manifests(spark, rows):
    docs = spark.createDataFrame(rows, COLUMNS)
    docs = docs.withColumns({c: F.lit(1) for c in ("tree", "pos", "leaf", "n", "step", "tampered", "n_rows", "pos_part")})
    out = merkle.manifest(docs, merkle.tampered_text(docs)).collect()
    key = lambda r: tuple(map(str, r))
    return sorted(map(tuple, out), key=key), sorted(plain_manifest(rows), key=key)


def test_manifest_with_nulls_repeats_and_many_languages(spark):
    rng = random.Random(3)
    rows = [(i, "web", rng.choice(["en", "en", "en", "de", None, "é", "Z"]), i, rng.choice(["Abc", "abc", "", None, "É x"])) for i in range(700)]
    rows += [(None, None, "en", None, "A")] * 9 + [(5, "web", "en", 5, "Same")] * 3 + [(5, "web", "en", 5, "Other")]
    rows += [(1000 + i, "s", f"lang{i}", 1, "One") for i in range(20)]
    got, want = manifests(spark, rows)
    assert got == want
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 8, 9])
def test_manifest_of_one_language(spark, n):
    got, want = manifests(spark, [(i, "s", "en", 1, "Text " * i) for i in range(n)])
    assert got == want


def test_manifest_beyond_one_block(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DEEP", 1)  # blocks of 8 leaves, so that upper rungs are copied
    got, want = manifests(spark, [(i, "s", "en" if i % 3 else "de", 1, f"T{i}") for i in range(700)])
    assert got == want


def test_manifest_of_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], COLUMNS)).count() == 0


# Spelling variants


def plain_variants(rows) -> list[tuple]:
    counts: Counter = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 2}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return sorted(out)


def test_variants_equal_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    stems = ["mountain", "mountains", "fountain", "fontaine", "abcdefg", "aaaaaaa", "aaaaaaaa", "Éclairée", "größeren", "x×÷yzabc"]
    rows = []
    for i in range(300):
        words = []
        for _ in range(12):
            w = list(rng.choice(stems[: 1 + int(len(stems) * rng.random())]))
            for _ in range(rng.choice([0, 0, 0, 0, 1, 2])):
                k = rng.randrange(len(w))
                w[k : k + rng.choice([0, 1])] = rng.choice(["", "e", "s", "é"])
            words.append("".join(w))
        rows.append((i, " ".join(words)))
    rows += [(None, "mountain mountaim, mountaim"), (1, None), (2, ""), (3, "short words ab")] + [(7, "mountain " * 400)] * 2
    rows += [(500 + i, "chainabc " * (i < 3) + "chainabd " + "chainxbd " * 15) for i in range(40)]  # a way of two steps
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("word", "n", "bucket", "run", "call")})
    want = plain_variants(rows)
    assert len(want) > 200 and any(r[1] != r[2] for r in want if r[1])
    assert sorted(map(tuple, spelling.variants(docs).collect())) == want
    words = spelling.count_words(docs)
    pairs = sorted(map(tuple, spelling.near_words(words).collect()))
    for segments, tile in ((1, 16), (2, 1000), (6, 3)):
        assert sorted(map(tuple, spelling.near_words(words, segments, tile).collect())) == pairs


def test_variants_of_nothing(spark):
    assert spelling.variants(spark.createDataFrame([(1, None)], "doc_id long, text string")).count() == 0


# Sentence pieces

PARTS = ["a", "b", " ", "  ", "▁", "\t", "\n", "é", "é", "ﬁ", "　", "​", " ", "日本", "가", "가", "ｶﾞ", "the", "ing",
         " the", "hello", "😀", "\x00", "ö", "½", "…", "¨", "aaaa", "1", ".", ",", "<s>", "<0x41>", "﻿", "­"]


def model(rule: str | None, trim: int = 0, dummy: int = 1) -> bytes:
    """The public model, with another character map and other treatment of spaces: fields that come
    later in a message hold."""
    import public_tokenizers
    import sentencepiece

    with open(public_tokenizers.path(sentence_pieces.MODEL), "rb") as f:
        content = f.read()
    if rule is None:
        return content
    spec = bytes(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec())
    spec += b"\x18" + bytes((dummy,)) + b"\x20" + bytes((trim,))
    size, left = b"", len(spec)
    while left > 127:
        size, left = size + bytes((left & 127 | 128,)), left >> 7
    return content + b"\x1a" + size + bytes((left,)) + spec


@pytest.mark.parametrize("rule,trim,dummy", [(None, 0, 1), ("nmt_nfkc", 1, 1), ("nfkc", 0, 1), ("nmt_nfkc_cf", 0, 0), ("identity", 1, 1)])
def test_pieces_and_spans_equal_the_library(rule, trim, dummy):
    import sentencepiece

    content = model(rule, trim, dummy)
    library, own = sentencepiece.SentencePieceProcessor(model_proto=content), sentence_pieces.Memo(sentence_pieces.Pieces(content), 500)
    rng = random.Random(7)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    texts += ["", " ", "aXq" * 2000, "日本" * 500, "word. " * 3000, "a" * 3000, "\n\n ab \n"]
    for text in texts:
        want = []
        for field, value in sentence_pieces.read_fields(library.encode(text, out_type="serialized_proto")):
            if field == 2:
                piece = dict(sentence_pieces.read_fields(value))
                want.append([piece.get(2, 0), piece.get(4, 0), piece.get(5, 0)])
        assert own.encode(text).tolist() == want, repr(text)
        ids = [rng.randrange(300) if rng.random() < 0.7 else rng.randrange(32000) for _ in range(rng.randint(0, 6))]
        for some in (ids, [row[0] for row in want]):
            assert own.pieces.decode(some) == library.decode(some), some


def test_pieces_of_rows(spark):
    texts = ["Hello  world.\n", None, "", "日本 é", "x" * 100_000, "Hello  world.\n"]
    docs = spark.createDataFrame([(i % 3 or None, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, ids int, decoded int")
    out = sentence_pieces.encode(docs, carry=("doc_id", "text"), decoded=True).collect()
    assert len(out) == len(texts) and all(r.decoded == (r.text or "") for r in out)
    for r in out:
        blob = (r.text or "").encode()
        assert b"".join(blob[a:b] for a, b in zip(r.starts, r.ends)) == blob
    assert all(r.decoded == (r.text or "") for r in sentence_pieces.decode(sentence_pieces.encode(docs, carry=("text",))).collect())
    assert sentence_pieces.encode(docs.limit(0)).count() == 0


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        sentence_pieces.Pieces(model(None) + b"\x12\x02\x18\x01")  # a unigram model
