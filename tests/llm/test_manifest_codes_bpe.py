"""Manifests, vector codes and byte-level BPE against brute force, on odd rows too."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import bpe, manifest, vectorcodes

DOCS = "doc_id long, source string, lang string, n_chars long, text string, G string, digest string, path string"


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf_of(*values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def path_of(levels, at):
    out = []
    for level in levels[:-1]:
        run = level[at // 8 * 8 : at // 8 * 8 + 8]
        out.append((at % 8, run[: at % 8] + run[at % 8 + 1 :]))
        at //= 8
    return out


def manifest_brute(rows):
    """(doc_id, leaf, subroot, root, digest of the proof, folded root) of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(*r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for at, (_, _, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = path_of(trees[g], at) + path_of(top, k)
            now = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                now = leaf_of(*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            for place, others in path:
                now = sha(*others[:place], now, *others[place:])
            out.append((r[0], leaf, trees[g][-1][0], top[-1][0], sha(*(x for _, others in path for x in others)), now))
    return sorted(out, key=str)


def manifest_rows(spark, rows, height):
    """The query's columns of rows, with its own fold, by blocks of so many levels."""
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS)
    named = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    probe = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, manifest.digest_of([*named, low]))
    leaves = docs.withColumns({"leaf": manifest.digest_of([*named, F.col("text")]), "probe": probe})
    found = manifest.manifest(leaves, keep=("probe",), height=height)
    assert found.columns == ["lang", "doc_id", "leaf", "probe", "subroot", "root", "path"]
    return sorted((tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", F.sha2(manifest.siblings(F.col("path")), 256), manifest.folded(F.coalesce("probe", "leaf"), F.col("path"))).collect()), key=str)


@pytest.mark.parametrize("height", [1, 2, 4])
def test_manifest_equals_brute_force(spark, height):
    rnd = random.Random(7)
    rows = [(i, rnd.choice(["web", None, "büch"]), rnd.choice(["en", "en", "en", "é", None, ""]), rnd.choice([None, i]), rnd.choice([f"Text {i} Über", None, "", "plain"])) for i in range(150)]
    rows += [(None, None, None, None, None)] * 9 + [(7, "a", "en", 1, "SAME"), (7, "b", "en", 1, "same")] + [(8, "a", "en", 1, "twice")] * 10 + [(-5, "a", "lone", 1, "A"), (3, "a", "long", 1, "Xy" * 200_000)]
    assert manifest_rows(spark, rows, height) == manifest_brute(rows)


def test_manifest_with_many_groups(spark):
    rows = [(i, "s", f"l{i % 90:03}", 1, f"T{i}") for i in range(200)]
    assert manifest_rows(spark, rows, 1) == manifest_brute(rows)


def test_manifest_of_one_row_and_of_none(spark):
    assert manifest_rows(spark, [(1, "s", "en", 1, "A")], 4) == manifest_brute([(1, "s", "en", 1, "A")])
    assert manifest_rows(spark, [], 4) == []


def test_tampered_texts_alone_fail(spark):
    rows = [(i, "s", "en", 1, "Big" if i % 2 else "small") for i in range(100)]
    for doc_id, _, _, root, _, folded in manifest_rows(spark, rows, 2):
        assert (folded == root) == (doc_id % 2 == 0 or zlib.crc32(str(doc_id).encode()) % 3 > 0)


def test_sweeps_inside_a_block():
    leaves = [sha(str(i)) for i in range(77)]
    nodes = manifest.climb(leaves, 3)
    assert nodes == tree(leaves)
    for at, step in enumerate(manifest.descend(nodes)):
        path = []
        while step:
            path.append((step[0], step[1]))
            step = step[2]
        assert path == [(place, "".join(others)) for place, others in path_of(nodes, at)]


def codes_brute(rows, parts=4, entries=256, rounds=4):
    """(key, label, code, error) and codebooks by comparing every part with every entry."""
    kept = [(k, [math.floor(1024 * x) for x in v], label) for k, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    sizes = [len(v) for _, v, _ in kept]
    kept = [r for r in kept if len(r[1]) == max(set(sizes), key=lambda s: (sizes.count(s), s))]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], []
    d = len(kept[0][1]) // parts
    cut = [[v[p * d : (p + 1) * d] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        found = [[near(p, c[p])[1] for c in cut] for p in range(parts)]
        for p in range(parts):
            for e in set(found[p]):
                mine = [c[p] for c, i in zip(cut, found[p]) if i == e]
                books[p][e] = [sum(x[j] for x in mine) // len(mine) for j in range(d)]
    out = []
    for (k, _, label), c in zip(kept, cut):
        best = [near(p, c[p]) for p in range(parts)]
        out.append((k, label, [i for _, i in best], sum(x for x, _ in best)))
    return out, books


VECTORS = "vec_id long, embedding array<float>, label int, k string, error long, V string"


@pytest.mark.parametrize("n, entries", [(300, 16), (60, 16), (10, 16), (200, 1)])
def test_codes_equal_brute_force(spark, n, entries):
    rnd = random.Random(n)
    number = lambda: rnd.choice([rnd.gauss(0, 0.1), 0.0, 0.125, -0.125, 1 / 3])
    rows = [(i, [float(np.float32(number())) for _ in range(8)], rnd.choice([1, 2, 2, None])) for i in range(n)]
    rows += [(3, None, 1), (-9, [], 1), (-8, [None] * 8, 2), (-7, [float("nan")] + [0.0] * 7, 2), (-6, [float("inf")] * 8, 2), (-5, [0.1] * 4, 1), (None, [0.5] * 8, None), (None, [0.25] * 8, 1)]
    rows += [(1, [0.125] * 8, 2)] * 40
    rows = [(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for k, v, label in rows]
    df = spark.createDataFrame([(*r, "a", 5, "b") for r in rows], VECTORS)
    coded, books = vectorcodes.compress(df, entries=entries)
    want, want_books = codes_brute(rows, entries=entries)
    assert books.tolist() == want_books
    assert sorted(map(str, ((r.k, r.label, r.code, r.error) for r in coded.collect()))) == sorted(map(str, want))
    totals = {}
    for _, label, _, error in want:
        totals[label] = totals.get(label, 0) + error
    assert sorted(map(str, ((r.k, r.error, r.label_error) for r in vectorcodes.label_errors(coded).collect()))) == sorted(map(str, ((k, error, totals[label]) for k, label, _, error in want)))
    back = vectorcodes.decoded(coded, books).select("code", "vector").first()
    assert back.vector == [(float(x) + 0.5) / 1024 for p, c in enumerate(back.code) for x in books[p][c]]


def test_no_usable_vector(spark):
    for rows in ([], [(1, None, 1, "a", 1, "b")]):
        coded, books = vectorcodes.compress(spark.createDataFrame(rows, VECTORS))
        assert books.size == 0 and vectorcodes.label_errors(coded).collect() == []


def test_numbers_too_large_are_an_error(spark):
    df = spark.createDataFrame([(i, [1e9 * i] * 8, 1, "a", 1, "b") for i in range(3)], VECTORS)
    with pytest.raises(Exception, match="too large"):
        vectorcodes.compress(df)


def test_search_finds_ties_and_far_entries():
    rnd = np.random.default_rng(3)
    for spread in (1, 3, 500):
        entries, x = rnd.integers(-spread, spread + 1, (200, 4)), rnd.integers(-spread, spread + 1, (3000, 4))
        all_of = ((x[:, None, :] - entries[None]) ** 2).sum(2)
        index, distance = vectorcodes.Book(entries).nearest(x)
        assert np.array_equal(index, all_of.argmin(1)) and np.array_equal(distance, all_of.min(1))


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(bpe.vocabulary(bpe.RANKS), bpe.code_point_classes())


@pytest.fixture(scope="module")
def library(coder):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


SIGNS = ["a", "b", "L", " ", "  ", "\n", "\t", "'", "'s", "'ll", "'l", "'re", "'r", "'ve", "'d", "'t", "'m", "'S", "1", "22", "!", ".", "é", "日", " ", "\u0085", "\x1c", "😀", "٣", "<|endoftext|>"]


@pytest.mark.parametrize("scan", [3, 64, 1 << 20])
def test_ids_equal_the_librarys(coder, library, monkeypatch, scan):
    monkeypatch.setattr(bpe, "SCAN", scan)
    rnd = random.Random(scan)
    texts = ["", " ", "'", "x" * 3000, "ab" * 1500] + ["".join(rnd.choice(SIGNS) for _ in range(rnd.randrange(30))) for _ in range(3000)]
    for text, (ids, ends) in zip(texts, coder.encode(texts, at_once=100)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert coder.decode(ids, ends, at_once=7) == text.encode()


def test_classes_of_all_code_points(coder, library):
    """Every code point between letters, numbers, blanks and itself."""
    for begin in range(0, 0x110000, 1 << 14):
        text = "".join(f"a{c}'s {c}{c} 1{c}\n{c}" for c in map(chr, range(begin, begin + (1 << 14), 3)) if not "\ud800" <= c <= "\udfff")
        assert np.frombuffer(coder.encode([text])[0][0], "<u4").tolist() == library.encode_ordinary(text)


def test_ranges_and_damage(coder):
    text = "héllo wörld, it's 日本語 😀 ok".encode()
    ids, ends = coder.encode([text.decode()])[0]
    assert all(coder.decode_range(ids, ends, a, b) == text[a:b] for a in range(len(text) + 2) for b in range(len(text) + 2))
    with pytest.raises(ValueError):
        coder.decode(ids[4:] + ids[:4], ends)


def test_coded_rows_and_odd_rows(spark, library):
    rows = [(1, "It's  odd\n\n text", "x", "y"), (None, None, None, None), (2, "", "x", "y"), (2, "", "x", "y"), (3, "ab '" * 300_000, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, k0 string")
    coded = bpe.encode(df)
    got = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded).decode()) for r in bpe.decode(coded).collect()]
    assert sorted(got, key=str) == sorted(((k, library.encode_ordinary(t or ""), t or "") for k, t, _, _ in rows), key=str)
    assert bpe.decode(bpe.encode(df.limit(0))).collect() == []
