"""Operators against brute force on small rows, and their defined results for odd input."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import common, components, configuration, decontaminate, language, licences, neardup, packing, secrets, tokenfile, tokens, toxicity, warc, winnow

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
random.seed(7)
VOCABULARY = ["".join(random.choice("abcdefghijklmnop") for _ in range(random.randint(2, 7))) for _ in range(120)]


def prose(n: int) -> str:
    return " ".join(random.choice(VOCABULARY) for _ in range(n))


def docs_of(spark, texts, **columns):
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def near_copies() -> list:
    """Bases, copies with a few words changed, exact copies, odd texts."""
    out = [None, "", "   ", "one", "ONE", "one two", "One Two"]
    for size in (8, 30, 60, 120):
        base = prose(size).split()
        for _ in range(12):
            copy = list(base)
            for _ in range(random.randint(0, max(1, size // 8))):
                copy[random.randrange(size)] = random.choice(VOCABULARY)
            out.append(" ".join(copy))
        out += [" ".join(base)] * 3
    return out


def shingles(text, k):
    words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall("[^\x20\x09-\x0d]+", text or "")]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_components(texts, k, percent=80):
    sets = [shingles(t, k) for t in texts]
    comp = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    return sets, comp


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(spark, k):
    texts = near_copies()
    sets, comp = brute_components(texts, k)
    got = {r.doc_id: r for r in neardup.find_components(docs_of(spark, texts), shingle=k).collect()}
    assert [got[i].component_id for i in range(len(texts))] == comp
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]


def test_near_duplicates_among_boilerplate(spark, monkeypatch):
    """Documents that share half of their text crowd the buckets; their groups must come out whole all the same."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    shared, texts = prose(40), []
    for _ in range(60):
        own = prose(30).split()
        for _ in range(random.choice([1, 1, 2, 4])):
            copy = list(own)
            copy[random.randrange(30)] = random.choice(VOCABULARY)
            texts.append(f"{shared} {' '.join(copy)}")
    _, comp = brute_components(texts, 2)
    got = {r.doc_id: r.component_id for r in neardup.find_components(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == comp and len(set(comp)) > 20


def test_near_duplicates_odd_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "a b c d"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit("x"), "sig": F.lit(1)})
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in neardup.find_components(df).collect())
    assert got == [(False, 1, 1), (False, 1, 1), (False, 2, 1), (False, 3, 3), (True, 0, None)]
    assert neardup.find_components(df.limit(0)).count() == 0


def test_blocks_join_components_exactly():
    import pyarrow as pa

    sets = [np.arange(i, i + 20, dtype=np.uint64) for i in range(0, 12, 2)]
    functions = neardup._functions(240)
    table = pa.table({"node": list(range(6)) * 2, "c": list(range(6)) * 2, "set": [s.tobytes() for s in sets] * 2, "sig": [neardup.signature(s << np.uint64(40), functions) for s in sets] * 2, "asking": [True] * 6 + [False] * 6})
    out = neardup._joining_links(table, 80)
    assert {tuple(sorted(x)) for x in zip(out["a"].to_pylist(), out["b"].to_pylist())} == {(i, i + 1) for i in range(5)}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def contaminated_brute(text, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    words, hit, found = cut(text), set(), set()
    for item, said in items:
        w = cut(said)
        n = min(13, len(w))
        for s in range(len(w) - n + 1) if w else ():
            for at in range(len(words) - n + 1):
                if words[at : at + n] == w[s : s + n]:
                    hit |= set(range(at, at + n))
                    found |= {str(item)} - {"None"}
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_words", [500_000, 30])
def test_decontamination_equals_brute_force(spark, block_words):
    items = [(i, prose(random.choice([1, 2, 5, 13, 25]))) for i in range(8)] + [(20, None), (21, "!!"), (3, prose(15)), (22, "Éa bé " * 10), (None, "unnamed words here")]
    texts = [None, "", "...", "éa BÉ " * 12, "some unnamed words here"] + [prose(30) + ", " + random.choice(items[:8])[1] + "; " + prose(random.randint(0, 200)) for _ in range(8)] + [prose(40)]
    docs = docs_of(spark, texts).withColumn("spans", F.lit(0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.found.n_words, r.found.n_hit, r.found["items"]) for r in decontaminate.find_contamination(docs, bench, ["doc_id"], block_words=block_words).collect()}
    assert got == {i: contaminated_brute(t, items) for i, t in enumerate(texts)}
    none = decontaminate.find_contamination(docs, bench.limit(0), ["doc_id"]).collect()
    assert all(r.found.n_hit == 0 and r.found["items"] == [] and r.found.max_containment == 0 for r in none) and len(none) == len(texts)


def test_partial_containment(spark):
    item = prose(13)
    words = item.split()
    words[6] = "zzz"
    df = docs_of(spark, [" ".join(words), prose(20)])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    strict = decontaminate.find_contamination(df, bench, ["doc_id"]).orderBy("doc_id").collect()
    loose = decontaminate.find_contamination(df, bench, ["doc_id"], containment=0.7).orderBy("doc_id").collect()
    assert [r.found.n_hit for r in strict] == [0, 0] and [r.found.n_hit for r in loose] == [13, 0]


def test_secrets_base_and_ownership(spark):
    live, shared, key = "9f8A7b6C5d4E3f2G1h0Jk", "copied_Example_1234", "AKIA" + "ABCDEFGH12345678"
    texts = [None, "", f'Token = "{live}" x', f"é password:{shared}", f"SECRET={shared}", f"api_key : '{shared}'", f"{key} and {'0a' * 20}", "token=secret:abcdefghi", "ſecret=abcdefghijkl", f"aaaa {'Xy3' * 9}k9QzW {live}zz"]
    got = {r.doc_id: r.secrets for r in secrets.find_secrets(docs_of(spark, texts).withColumn("spans", F.lit("x")), F.col("source"), F.col("source"), ["doc_id"]).collect()}
    assert [(got[i].n_assign, got[i].n_access, got[i].n_hex) for i in range(9)] == [(0, 0, 0), (0, 0, 0), (1, 0, 0), (1, 0, 0), (1, 0, 0), (1, 0, 0), (0, 1, 1), (0, 0, 0), (0, 0, 0)]
    assert [(s.live, s.shared) for s in got[2].spans] == [(True, False)] and [(s.live, s.shared) for s in got[3].spans] == [(False, True)]
    assert got[6].base_sha256 == hashlib.sha256(f"access:0:20,hex:25:65".encode()).hexdigest() and got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secrets.find_secrets(docs_of(spark, []), F.col("source"), F.col("source"), ["doc_id"]).count() == 0


def test_masking_keeps_the_rest(spark):
    texts = ["é token = abcDEF123456789 end", "plain", None]
    out = {r.doc_id: r for r in secrets.mask_secrets(spark, docs_of(spark, texts), "").collect()}
    assert out[0].text == "é [SECRET] end" and out[0].n_chars == len(out[0].text) and out[1].text == "plain" and out[2].text is None


def test_masking_takes_short_plain_and_copied_secrets(spark):
    copied, shared = "token=9f8A7b6C5d4E3f2G1h0Jk in each copy", "secret=copied_Example_1234"
    texts = ["password=changeme1 x", f"hex {'0a' * 20} y", "AKIA" + "A" * 12 + " z", copied, copied, copied, f"a {shared}", f"b {shared}", f"c {shared}"]
    out = {r.doc_id: r.text for r in secrets.mask_secrets(spark, docs_of(spark, texts), "").collect()}
    assert [out[i] for i in range(3)] == ["[SECRET] x", "hex [SECRET] y", "[SECRET] z"]
    assert {out[i] for i in (3, 4, 5)} == {"[SECRET] in each copy"} and [out[i] for i in (6, 7, 8)] == texts[6:]


def test_encoder_equals_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    odd = ["", " ", "  ", "a  b", "a \n b", "\n\n x", "it's we'll  'S", "x <|endoftext|> y", "İstanbul ẞ ß", "é áb", "a\x1cb c", "日本 語", " x  y", "1234 5.6,7 a.,b c...", "tab\tx", "end ", " start", "A\r\nB", "naïve, ÉCOLE. ÿ ×÷ ª º", "ﬁ ſ K", "w" * 500]
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        path = public_tokenizers.path(name)
        whole = Tokenizer.from_file(path)
        whole.encode_special_tokens = True
        mine = tokens.Encoder(path, spaced)
        for _ in range(2):
            assert [np.frombuffer(b, "<u4").tolist() for b in mine.encode(odd)] == [whole.encode(t, add_special_tokens=False).ids for t in odd]


def test_punctuated_words_go_straight_to_the_merge_model(monkeypatch):
    from tokenizers import Tokenizer

    random.seed(29)
    made = lambda: "".join(random.choice("abeinorstÉèüß") for _ in range(random.randint(1, 9))) + random.choice(["", ".", ",", "&&&", "$$$", "_-", ")]}", "!?"])
    texts = [" ".join(random.choice([made(), f"{made()}\n{made()}"]) for _ in range(40)) for _ in range(30)]
    odd = ["it's 'so'\ns a.'\nll b.\n\nC x<|endoftext|>\nno y.<|endoftext|> z", "a.\n b\n", "\nA\nB.\nC", "1&&&\nA2 A$3"]
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        path = tokens.vocabulary(name)
        whole = Tokenizer.from_file(path)
        mine, seen = tokens.Encoder(path, spaced, special_as_text=False), []
        encode_whole = mine._encode_whole
        monkeypatch.setattr(mine, "_encode_whole", lambda pieces: seen.extend(pieces) or encode_whole(pieces))
        got = mine.encode(texts)
        assert not any(c.isalpha() for piece in seen for c in piece)
        assert [np.frombuffer(b, "<u4").tolist() for b in got + mine.encode(odd)] == [whole.encode(t, add_special_tokens=False).ids for t in texts + odd]


def test_pieces_still_met_outlive_a_full_table(monkeypatch):
    mine = tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json"), True, most_bytes=4_000)
    learned, learn = [], mine._learn
    monkeypatch.setattr(mine, "_learn", lambda pieces, *more: learned.extend(pieces) or learn(pieces, *more))
    texts = [" ".join(["x", "often", *(f"seldom{10 * i + k}" for k in range(10))]) for i in range(20)]
    expected = tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json"), True).encode(texts)
    assert [mine.encode([t])[0] for t in texts] == expected
    assert learned.count("often") == 1 and mine.held < 4_000


def test_words_are_merged_once_for_all_pieces_that_hold_them(monkeypatch):
    from tokenizers import Tokenizer

    odd = [None, "", "\n", "a\n", "\na", "\xa0a b\xa0", "A\xa0 b", "--", "-- --", ", a ,", "...\nA", "a.\n.b", "a\n\nb", "Ġ Ċ Ġa", "a\x00b \x00", "l'été d'ÿ", "e\u0301 e", "x" * 400, "ß\nß, ß"]
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        path = tokens.vocabulary(name)
        whole = Tokenizer.from_file(path)
        mine, learned = tokens.Encoder(path, spaced, special_as_text=False), []
        learn = mine._learn
        monkeypatch.setattr(mine, "_learn", lambda keys: learned.extend(keys) or learn(keys))
        texts = ["x often often, often.\nOften", "y often; (often) often!?\noften often,"]
        for t in (texts, pa.array(texts[::-1] + odd, pa.string()), pa.array([*odd, "cut off"]).slice(3, 9)):
            got = [np.frombuffer(b, "<u4").tolist() for b in mine.encode(t)]
            assert got == [whole.encode(x or "", add_special_tokens=False).ids for x in (t if isinstance(t, list) else t.to_pylist())]
        assert sum(k.lower().strip() == "often" for k in learned) == (3 if spaced else 1)
        assert not any(len(k) > tokens.LONGEST_KEPT for k in mine.known) and mine.encode([]) == []


def test_encoder_of_the_operators_equals_an_untouched_tokenizer():
    from tokenizers import Tokenizer

    odd = ["ab <|endoftext|> cd", "<|endoftext|>", "a<|startoftext|>b c <|ENDOFTEXT|>", " <|endoftext|>  x\n<|endoftext|> y", "a <|endoftext |> b", "plain words.", "é\x1c<|endoftext|>"]
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        path = tokens.vocabulary(name)
        whole = Tokenizer.from_file(path)
        for _ in range(2):
            assert [np.frombuffer(b, "<u4").tolist() for b in tokens.encoder(path, spaced).encode(odd)] == [whole.encode(t, add_special_tokens=False).ids for t in odd]


def test_packing_is_whole_and_tight(spark):
    texts = [None, ""] + [prose(random.choice([3, 40, 200])) for _ in range(60)] + [prose(3000)] * 2
    rows = common.write_shared(packing.tokenized_pieces(docs_of(spark, texts), keep_ids=True), "pieces")
    got = packing.pack(rows).collect()
    assert len(packing.pack(rows.limit(0)).collect()) == 0 and packing.pack(rows, block_pieces=3).select("sequence_id").distinct().count() == len({r.sequence_id for r in got})
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
    for parts in by_doc.values():
        parts.sort(key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(len(parts))) and [p.length for p in parts[1:]] == [2048] * (len(parts) - 1)
        assert [p.start for p in parts] == [sum(q.length for q in parts[:i]) for i in range(len(parts))]
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        assert [p.offset for p in parts] == [sum(q.length for q in parts[:i]) for i in range(len(parts))] and sum(p.length for p in parts) <= 2048
    assert set(by_doc) == set(range(len(texts))) and len(by_sequence) <= -(-sum(r.length for r in got) // 2048) + 1


def test_knapsack_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        capacity = int(rng.integers(1, 150))
        worth = np.zeros(capacity + 1)
        for n in rng.integers(1, capacity + 1, rng.integers(1, 12)):
            worth[n] = rng.random() * n
        best = [0.0] * (capacity + 1)
        for room in range(1, capacity + 1):
            best[room] = max([best[room - 1]] + [best[room - n] + worth[n] for n in range(1, room + 1) if worth[n] > 0])
        value, pattern = configuration.Knapsack(capacity).solve(worth)
        assert abs(value - best[capacity]) < 1e-5 * capacity and sum(n * k for n, k in pattern.items()) <= capacity
        assert abs(sum(worth[n] * k for n, k in pattern.items()) - value) < 1e-5 * capacity


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(3)
    for top in (50, 2047):
        counts = {int(n): int(c) for n, c in zip(rng.integers(1, top + 1, 60), rng.integers(1, 500, 60))}
        used = {}
        for pattern, times in packing.plan(counts, 2048):
            assert sum(n * k for n, k in pattern.items()) <= 2048
            for n, k in pattern.items():
                used[n] = used.get(n, 0) + k * times
        assert used == counts
    assert packing.plan({}, 2048) == []


def test_program_is_near_its_bound_and_does_the_packing():
    rng = np.random.default_rng(5)
    lengths = rng.lognormal(6, 1, 1500).astype(int).clip(1, 2047)
    counts = {int(n): int(c) * 100 for n, c in zip(*np.unique(lengths, return_counts=True))}
    found = configuration.solve(counts, 2048)
    assert found.bound <= found.value <= 1.02 * found.bound
    chosen, left = configuration.rounded(found, counts)
    assert sum(left.values()) <= 0.1 * sum(counts.values())
    total = sum(times for _, times in packing.plan(counts, 2048))
    assert total <= found.value + len(left) + 1 and total <= sum(times for _, times in packing.best_fit(counts, 2048))


def test_plan_is_least_on_small_cases():
    import functools

    @functools.lru_cache(None)
    def least(pieces: tuple, capacity: int) -> int:
        """The fewest sequences, by trying all sets that hold the largest piece."""
        if not pieces:
            return 0
        rest, best = pieces[1:], len(pieces)
        for mask in range(1 << len(rest)):
            chosen = [rest[i] for i in range(len(rest)) if mask >> i & 1]
            if pieces[0] + sum(chosen) <= capacity:
                best = min(best, 1 + least(tuple(rest[i] for i in range(len(rest)) if not mask >> i & 1), capacity))
        return best

    rng, over = random.Random(11), []
    for _ in range(60):
        capacity = rng.randint(6, 20)
        pieces = tuple(sorted((rng.randint(1, capacity - 1) for _ in range(rng.randint(1, 9))), reverse=True))
        counts = {n: pieces.count(n) for n in set(pieces)}
        over.append(sum(times for _, times in packing.plan(counts, capacity)) - least(pieces, capacity))
    assert max(over) <= 1 and sum(over) <= 3


def test_token_files_round_trip(spark):
    texts = [prose(50), None, "", "x" * 3000] + [prose(400) for _ in range(6)]
    path = common.new_path(spark, "tokens")
    tokenfile.write_token_files(docs_of(spark, texts), path, frame_ids=300)
    got = tokenfile.read_token_files(spark, path).orderBy("doc_id").collect()
    mine = tokens.Encoder(tokens.vocabulary("word_bpe_49k.json"), False).encode([t or "" for t in texts])
    end = np.array([2], "<u4").tobytes()
    assert [bytes(r.ids) for r in got] == [b + end for b in mine] and [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    some = tokenfile.read_token_files(spark, path, [5, 1, 77]).orderBy("doc_id").collect()
    assert [(r.doc_id, bytes(r.ids)) for r in some] == [(i, mine[i] + end) for i in (1, 5)]
    odd, repeated = [(None, "b"), (None, None), (7, "a"), (7, "a"), (7, "b"), (-3, "c")], common.new_path(spark, "part-00009-tokens")
    tokenfile.write_token_files(spark.createDataFrame(odd, "doc_id long, text string"), repeated, file_chars=2)
    rows = tokenfile.read_token_files(spark, repeated).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, -3, 7, 7, 7] and [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(6)]
    assert sorted(bytes(r.ids) for r in rows) == sorted(b + end for b in tokens.Encoder(tokens.vocabulary("word_bpe_49k.json"), False).encode([t or "" for _, t in odd]))
    empty = common.new_path(spark, "tokens")
    tokenfile.write_token_files(docs_of(spark, []), empty)
    assert tokenfile.read_token_files(spark, empty).count() == 0


def test_token_file_decompresses_only_what_is_asked_and_sees_damage():
    writer = tokenfile.Writer(frame_ids=10)
    parts = [p for i in range(30) for p in writer.add(i if i else None, np.arange(i, dtype="<u4").tobytes())] + list(writer.finish())
    content = b"".join(p + b"\n" for p in parts)
    reader = tokenfile.Reader(content)
    assert [(k, x.tolist()) for k, x in reader.read([7, 29])] == [(7, list(range(7))), (29, list(range(29)))]
    damaged = bytearray(content)
    damaged[3] ^= 1
    reader = tokenfile.Reader(bytes(damaged))
    assert [k for k, _ in reader.read([29])] == [29]
    with pytest.raises(ValueError):
        list(reader.read([1]))


def test_cross_parsing_equals_a_plain_parse():
    draw = random.Random(2)
    wide = "".join(chr(0x4E00 + draw.randrange(3000)) for _ in range(3000))
    sample = {"aa": "abc abd acd " * 20, "bb": "xyz xzy zzy " * 20, "zh": wide}
    parser = language.CrossParser(sample)
    flat = {k: "".join(chr(c) for c in parser.code(v)) for k, v in sample.items()}
    texts = ["abc xyz", "abdabdabd", "zzzz zzy!", "ab" * 900, "", "?", "??a", "ééé a é", wide[50:90] + "\u4e00\u9fa5", "a" * 512 + "b", wide + "abc"]
    words = sample["aa"].split() + sample["bb"].split() + list(wide[:40])
    texts += ["ab" * n for n in (255, 256, 257, 2_000)] + ["abc abd acd " * 400, " ".join(draw.choice(words) for _ in range(3_000)), wide * 2]
    coded = [parser.code(t) for t in texts]
    for x, found in zip(coded, parser.phrases(coded)):
        said = "".join(chr(c) for c in x)
        for lang, n in zip(parser.langs, found):
            count = i = 0
            while i < len(said):
                size = 0
                while i + size < len(said) and said[i : i + size + 1] in flat[lang]:
                    size += 1
                i, count = i + max(1, size), count + 1 + (size == 0)
            assert n == count, (said[:20], lang)
    assert parser.phrases([]).shape == (0, 3) and parser.phrases([parser.code("")]).tolist() == [[0, 0, 0]]


def test_most_languages_are_those_of_the_most_documents(spark):
    rows = [(i, "the and of to in " * 3, "en") for i in range(40)] + [(100 + i, "der die das und ein " * 3, "de") for i in range(30)] + [(200 + i, "x y", f"junk{i}") for i in range(60)]
    sample = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_langs=2)
    assert sorted(sample) == ["de", "en"]


def test_languages_of_many_letters(spark):
    draw = random.Random(4)
    script = {lang: [chr(at + draw.randrange(900)) for _ in range(250)] for lang, at in (("ja", 0x3041), ("ko", 0xAC00), ("zh", 0x4E00))}
    rows = [(i, "".join(draw.choice(script[lang]) for _ in range(60)), lang) for i, lang in enumerate(["ja", "ko", "zh"] * 80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(df, language.learn(df)).collect()
    assert all(r.lang == r.lang_pred for r in got)


def test_language_odd_texts(spark):
    texts = ["der die das und ein " * 20, "the and of to in " * 20, None, "", "123 !!", "the of and in"] * 4
    langs = ["de", "en", None, "en", None, "en"] * 4
    df = docs_of(spark, texts).withColumn("lang", F.element_at(F.array(*(F.lit(x) for x in langs)), (F.col("doc_id") + 1).cast("int"))).withColumn("score", F.lit(1))
    got = {r.doc_id: r for r in language.identify(df, language.learn(df)).collect()}
    assert [got[i].lang_pred for i in range(6)] == ["de", "en", "und", "und", "und", "en"] and all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language.identify(df, {}).collect()} == {"und"}
    assert language.learn(df.limit(0)) == {}
    assert language.keep_spoken(spark, df, "").count() == 12


def fingerprint_brute(text, gram, window):
    import xxhash

    hashes = []
    for w in re.findall(r"[^\s]{1,16}", text or ""):
        v = xxhash.xxh64_intdigest(w.encode(), seed=42)
        hashes.append((v - (1 << 64) if v >> 63 else v) % winnow.PRIME)
    if not hashes:
        return []
    roll = lambda part: sum(h * pow(winnow.BASE, len(part) - 1 - i, winnow.PRIME) for i, h in enumerate(part)) % winnow.PRIME
    grams = [roll(hashes[i : i + gram]) for i in range(max(1, len(hashes) - gram + 1))]
    out = []
    for i in range(max(1, len(grams) - window + 1)):
        part = grams[i : i + window]
        at = max(j for j, v in enumerate(part, i) if v == min(part))
        if (min(part), at) not in out:
            out.append((min(part), at))
    return out


@pytest.mark.parametrize("gram, window", [(5, 4), (3, 1), (1, 7)])
def test_winnowing_equals_brute_force(spark, gram, window):
    texts = [None, "", " ", "one", "a b c", "same same same same same same same same same same", "x" * 100] + [prose(n) for n in (5, 8, 9, 60)]
    got = winnow.with_fingerprints(docs_of(spark, texts), {"text": "f"}, gram, window).orderBy("doc_id").select(winnow.as_text(F.col("f")).alias("t")).collect()
    assert [r.t for r in got] == [" ".join(f"{h}:{p}" for h, p in fingerprint_brute(t, gram, window)) for t in texts]


def test_shifted_unspaced_texts_share_fingerprints(spark):
    thai = "".join(chr(random.randint(0x0E01, 0x0E2E)) for _ in range(3000))
    part = thai[100:123]
    texts = [thai, "ก" + thai, "x" * 40 + part + "y" * 40, "😀 日本 " + "😀" * 17, "ab " + "c" * 16 + " " + "d" * 17]
    df = docs_of(spark, texts)
    got = [{h for h in r.h} for r in winnow.with_fingerprints(df, {"text": "f"}, sliding=True).orderBy("doc_id").select(winnow.hashes_of(F.col("f")).alias("h")).collect()]
    assert len(got[0] & got[1]) > 0.98 * len(got[0] | got[1]) and got[0] & got[2]
    cut = [r.w for r in df.orderBy("doc_id").select(winnow.words(F.col("text"), True).alias("w")).collect()]
    assert cut[3] == ["😀", "日", "本", "😀" * 16, "😀" * 16] and cut[4] == ["ab", "c" * 16, "d" * 16, "d" * 16]


def test_next_document_wraps_and_crosses_blocks(spark, monkeypatch):
    monkeypatch.setattr(winnow, "BLOCK_ROWS", 3)
    ids = [5, 1, 9, 3, 30, 12, 7, 2, 40, 41, 8]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.next for r in winnow.with_next(df, "text").collect()}
    order = sorted(ids)
    assert got == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1])}
    assert winnow.with_next(df.limit(0), "text").count() == 0
    assert [r.next for r in winnow.with_next(df.limit(1), "text").collect()] == ["t5"]


def test_toxicity_lexicon_context_and_odd_texts(spark):
    trie = toxicity.FuzzyTrie(["idiot", "scum", "worthless"])
    distance = lambda a, b: min((distance(a[1:], b[1:]) + (a[0] != b[0]), distance(a[1:], b) + 1, distance(a, b[1:]) + 1)) if a and b else len(a) + len(b)
    for word in ["idiot", "idi0t", "idot", "iidiot", "ixxot", "scum", "scam", "worthles", "w0rthles", "w0rthlesx", "x", ""]:
        best = min(distance(word, t) for t in trie.terms if distance(word, t) <= toxicity.edits_allowed(t)) if any(distance(word, t) <= toxicity.edits_allowed(t) for t in trie.terms) else None
        assert trie.nearest(word) == best, word
    scorer = toxicity.Scorer(["idiot"], [])
    assert scorer.features('you idiot')[0] > 0 and scorer.features('they said "idiot" once')[3] > 0 and scorer.features("an idi0t here")[2] > 0 and scorer.features("he said idiot")[0] > 0
    assert toxicity.Scorer(["idiot"], [], ["idiot"]).features("idiot idi0t") == [0, np.log1p(2), 0, 0]
    assert toxicity.Scorer(["a" * 90], []).features("a" * 88 + " " + "a" * 90)[:3] == [np.log1p(1), 0, np.log1p(1)]
    texts = [f"{prose(20)} {'idiot' if i % 4 == 0 else 'fine'} {prose(20)}" for i in range(240)] + [None, "", prose(10) + " idiiot"]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    assert model.terms == ["idiot"]
    got = {r.doc_id: r.score for r in toxicity.score(docs.withColumn("score", F.lit(0)), model).collect()}
    assert all((got[i] >= 0.3) == (i % 4 == 0) for i in range(240)) and got[242] >= 0.3 and got[240] == got[241] < 0.3
    assert toxicity.learn(docs, labels.limit(0)).terms == []


def test_licences_inherit_from_the_nearest(spark):
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/x.txt", prose(30)), ("a/b/c/y.txt", "text"), ("a/b/LICENSE.md", f"{prose(20)}\nLicensed under the Apache License, Version 2.0. {prose(9)}"), ("z/q.txt", None), (None, "Licensed under CC BY-NC 4.0."), ("top.txt", ""), ("a/x.txt", "repeat"), ("w/gpl.txt", "This work is licensed under the GNU General Public License, version 3.")]
    df = spark.createDataFrame(rows, "path string, text string").withColumn("licence", F.lit(1))
    got = {r.path: (r.licence, r.basis, r.from_dir) for r in licences.scan_licences(df).collect()}
    assert got == {"a/LICENSE": ("MIT", "own", None), "a/x.txt": ("MIT", "inherited", "a"), "a/b/c/y.txt": ("Apache-2.0", "inherited", "a/b"), "a/b/LICENSE.md": ("Apache-2.0", "own", None), "z/q.txt": (None, "none", None), None: ("CC-BY-NC-4.0", "own", None), "top.txt": (None, "none", None), "w/gpl.txt": ("GPL-3.0", "own", None)}
    assert licences.scan_licences(df.limit(0)).count() == 0


def test_licence_cosine_equals_brute_force(spark):
    texts = ["Released under the MIT License.", "Released under some License. Licensed under CC BY 4.0 today.", prose(12), "Licensed under the Apache License, Version 2.0 (the License)."]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    terms = sorted({t for ns in licences.TEMPLATES.values() for n in ns for t in licences._terms(n)})
    freq = {t: sum(t in licences._terms(x) for x in texts) for t in terms}
    vectors = licences.Vectors(licences.TEMPLATES, freq, len(texts), 0.75)
    best = {}
    for i, text in enumerate(texts):
        for passage in re.split(r"\n+|(?<=[.!?;])\s+", text):
            w = {t: licences._terms(passage).count(t) * vectors.idf.get(t, vectors.rare) for t in set(licences._terms(passage))}
            norm = sum(v * v for v in w.values()) ** 0.5
            dots = {}
            for licence, notice, term, v in vectors.entries:
                dots[licence, notice] = dots.get((licence, notice), 0) + v * w.get(term, 0)
            for (licence, _), dot in dots.items():
                if norm and round(dot / norm, 6) >= 0.75:
                    best[str(i)] = min(best.get(str(i), (0, "~")), (-round(dot / norm, 6), licence))
    got = {r.path: (-r.similarity, r.licence) for r in licences.own_licences(df).collect()}
    assert got == best and len(got) >= 2


def test_licence_scan_cuts_texts_once(spark):
    df = spark.createDataFrame([("a/LICENSE", "Released under the MIT License."), ("a/x.txt", prose(30)), ("b", None), ("c", "...")], "path string, text string")
    found = licences.scan_licences(df)
    assert {(r.path, r.licence, r.basis) for r in found.collect()} == {("a/LICENSE", "MIT", "own"), ("a/x.txt", "MIT", "inherited"), ("b", None, "none"), ("c", None, "none")}
    assert "split(" not in found._jdf.queryExecution().optimizedPlan().toString().replace("split(path", "").replace("split(dir", "")


def test_wrapped_headers_and_licence_texts_are_found(spark):
    import textwrap

    said = {f"{name}-{i}": (name, notice) for name, notices in licences.WHOLE.items() for i, notice in enumerate(notices)}
    rows = [(f"{key}-{mark}-{width}.c", prose(random.randint(20, 60)) + "\n" + "\n".join(f"{mark} {line}" for line in textwrap.wrap(notice, width)) + "\n" + prose(300)) for key, (_, notice) in said.items() for mark, width in (("#", 60), (" *", 76), ("", 10_000))]
    rows += [("cc.txt", "# This work is licensed under a Creative Commons Attribution 4.0\n# International License."), ("none.txt", prose(200) + " warranty license permission " + prose(200)), ("null", None)]
    got = {r.path: (r.licence, r.basis) for r in licences.scan_licences(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {**{path: (said[path.rsplit("-", 2)[0]][0], "own") for path, _ in rows[:-3]}, "cc.txt": ("CC-BY-4.0", "own"), "none.txt": (None, "none"), "null": (None, "none")}


def test_revisits_take_the_latest_earlier_response(spark):
    schema = "record_id long, url string, at long, warc_type string, status int, headers map<string,string>, body string"
    full = lambda i, at, tag, url="http://www.A.com/x/": (i, url, at, "response", 200, {"etag": tag, "content-type": "text/html", "date": "old"}, f"b{i}")
    again = lambda i, at, headers, url="https://a.com:443/x?utm_source=q#f": (i, url, at, "revisit", 304, headers, None)
    rows = [full(1, 10, "t1"), full(2, 20, "t2"), full(3, 20, "t3"), full(9, 5000, "t9"), again(4, 15, {"etag": "W/t1", "date": "new", "content-type": "no"}), again(5, 20, {"etag": "t1"}), again(6, 4000, {"etag": "t2"}), again(7, 5, {}), again(8, 4000, None), again(10, 50, {}, None), again(11, 6000, {"etag": "t9"})]
    for slice_rows in (1, 3, 100):
        got = {r.record_id: (r.verdict, r.response_id) for r in warc.resolve_revisits(spark.createDataFrame(rows, schema).withColumn("canonical", F.lit(1)), slice_rows).collect()}
        assert got == {4: ("resolved", 1), 5: ("resolved", 1), 6: ("validator_mismatch", None), 7: ("unresolved", None), 8: ("unverified", 3), 10: ("unresolved", None), 11: ("resolved", 9)}
    r = warc.resolve_revisits(spark.createDataFrame(rows, schema)).where("record_id = 4").first()
    assert r.headers == {"etag": "W/t1", "content-type": "text/html", "date": "new"} and r.body == "b1" and r.status == 200
    assert warc.resolve_revisits(spark.createDataFrame([], schema)).count() == 0


def test_revisits_with_repeated_and_missing_record_ids(spark):
    """Ids that other URLs use again, no ids at all, several bodies under one id, and revisits given twice."""
    schema = "record_id long, url string, at long, warc_type string, status int, headers map<string,string>, body string"
    full = lambda i, at, host, body: (i, f"http://{host}/", at, "response", 200, {"etag": body}, body)
    again = lambda i, at, host, tag: (i, f"http://{host}/", at, "revisit", 304, {"etag": tag}, None)
    rows = [full(1, 10, "a.com", "of a"), full(1, 10, "b.com", "of b"), full(1, 30, "a.com", "later"), full(None, 10, "c.com", "no id"), full(5, 10, "d.com", "x"), full(5, 10, "d.com", "z"), full(5, 10, "d.com", "y")]
    rows += [again(2, 20, "a.com", "of a"), again(2, 20, "b.com", "of b"), again(2, 40, "a.com", "later"), again(None, 20, "a.com", "of a"), again(3, 20, "c.com", "no id"), again(None, 20, "c.com", "stale"), again(4, 20, "d.com", "z"), again(4, 20, "d.com", "z"), again(1, None, "a.com", "of a")]
    for slice_rows in (1, 100):
        got = sorted((r.canonical, r.record_id or 0, r.verdict, r.response_id or 0, r.body or "") for r in warc.resolve_revisits(spark.createDataFrame(rows, schema), slice_rows).collect())
        assert got == sorted([
            ("a.com", 2, "resolved", 1, "of a"), ("b.com", 2, "resolved", 1, "of b"), ("a.com", 2, "resolved", 1, "later"), ("a.com", 0, "resolved", 1, "of a"), ("c.com", 3, "resolved", 0, "no id"),
            ("c.com", 0, "validator_mismatch", 0, ""), ("d.com", 4, "resolved", 5, "z"), ("d.com", 4, "resolved", 5, "z"), ("a.com", 1, "unresolved", 0, ""),
        ])


STAGES = {"language_id": language.keep_spoken, "near_duplicates": neardup.keep_one_of_each, "decontamination": decontaminate.drop_contaminated, "secrets": secrets.mask_secrets}
#: Names that the operators use inside, and others that are awkward.
CLASHES = ["lang_pred", "score", "node", "sig", "k1", "component_id", "n_shingles", "spans", "found", "n_hit", "n_words", "items", "row", "repo", "owner", "digest", "scan", "secrets", "bounds", "masked", "n_assign", "hash", "_text", "doc_row", "piece", "length", "Found", "parts", "hits"]


@pytest.fixture(scope="module")
def tiny_sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog and runs away now"), (None, "unnamed words here")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name", sorted(STAGES))
def test_stages_keep_clashing_columns_nulls_and_repeats(spark, tiny_sf, name):
    from lodestone.llm.common import of

    texts = [(1, "plain text of a few words"), (1, "plain text of a few words"), (None, "a text without a name"), (None, None), (2, None), (3, ""), (4, "token=9f8A7b6C5d4E3f2G1h0Jk"), (5, "x " * 20000)]
    clashes = [c for c in CLASHES if name != "none" and c != "Found"]
    rows = [(i, t, "en", "s", len(t or ""), *(f"{c}-{k}" for c in clashes)) for k, (i, t) in enumerate(texts)]
    fields = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in clashes)
    docs = spark.createDataFrame(rows, fields)
    out = STAGES[name](spark, docs, tiny_sf)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    kept = out.collect()
    by_mark = {r["spans"]: r for r in kept}
    assert len(by_mark) == len(kept)
    for k, (i, t) in enumerate(texts):
        r = by_mark.get(f"spans-{k}")
        gone = name == "language_id" and not any(c.isalpha() for c in t or "")
        assert (r is None) == gone, (name, k)
        if r is not None:
            assert r.doc_id == i and all(r[c] == f"{c}-{k}" for c in clashes)
            assert r.text == ("[SECRET]" if name == "secrets" and k == 6 else t)
    assert STAGES[name](spark, docs.limit(0), tiny_sf).count() == 0
    packed = packing.packed_sequences(spark, docs.select(*(of(c) for c in docs.columns)), tiny_sf)
    assert packed.select("doc_id").where("piece = 0").count() == len(texts) if name == "secrets" else True


def test_masking_joins_spans_that_touch():
    assert secrets.mask_text("0123456789", [(0, 2), (2, 4), (3, 6), (8, 10)]) == "[SECRET]67[SECRET]"
    assert secrets.mask_text("abc", []) == "abc" and secrets.mask_text("x" * 100_000, [(i, i + 1) for i in range(0, 100_000, 2)]).count("[SECRET]") == 50_000


def test_a_value_of_one_owners_repositories_is_no_shared_example(spark):
    value = "token=9f8A7b6C5d4E3f2G1h0Jk"
    rows = [(i, f"{value} {i}", f"owner{max(0, i - 5)}", f"repo{i}") for i in range(8)] + [(20 + i, f"secret=copied_Example_1234 {i}", f"owner{i}", "r") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, repo string")
    got = {r.doc_id: r.secrets.spans[0] for r in secrets.find_secrets(df, F.col("repo"), F.col("source"), ["doc_id"]).collect()}
    assert (got[0].live, got[0].shared, got[0].n_owners, got[0].n_repos) == (True, False, 3, 8)
    assert (got[20].live, got[20].shared, got[20].n_owners, got[20].n_repos) == (False, True, 3, 3)


def test_verbatim_copies_count_their_owners(spark):
    """One text at 20 owners: true counts decide `shared`, the pipeline's mask asks for different texts as well."""
    text = "token=9f8A7b6C5d4E3f2G1h0Jk and kQ8dWz3RtY6uPm1XcV9bN2sL in one file"
    df = spark.createDataFrame([(i, text, f"owner{i}", "en") for i in range(20)], "doc_id long, text string, source string, lang string")
    for r in secrets.find_secrets(df, F.concat_ws("/", "source", "lang"), F.col("source"), ["doc_id"]).collect():
        assert [(s.rank, s.shared, s.live, s.n_owners, s.n_repos, s.n_texts) for s in r.secrets.spans] == [(0, True, False, 20, 20, 1)]
    assert {r.text for r in secrets.mask_secrets(spark, df, "").collect()} == {"[SECRET] and [SECRET] in one file"}


def test_bare_runs_are_met_in_one_pass():
    """Bare runs among overlapping base spans, against a look at all pairs, and a long text in little time."""
    import time

    bare, runs = "kQ8dWz3RtY6uPm1XcV9bN2sLe", ["token=kQ8dWz3RtY6uPm1XcV9bN2sLe", "AKIA" + "B2" * 10 + "cdEf", "0a" * 20, "x" + "0f" * 16 + "Zq7Wd", "secret: abcdefgh"]
    rng = random.Random(5)
    for _ in range(300):
        text = rng.choice([" ", "", "-"]).join(rng.choice([bare, *runs]) for _ in range(rng.randint(0, 8)))
        found = secrets.candidates(text)
        base = [(s, e) for s, rank, e, _ in found if rank < 3]
        want = [m.span() for m in secrets._BARE.finditer(text) if secrets._varied(m[0]) and not any(s < m.end() and m.start() < e for s, e in base)]
        assert [(s, e) for s, rank, e, _ in found if rank == 3] == want
    began = time.perf_counter()
    assert len(secrets.candidates(f"{bare} token=abcdefgh1 " * 40_000)) == 80_000
    assert time.perf_counter() - began < 30
