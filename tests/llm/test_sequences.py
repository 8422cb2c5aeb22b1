"""Alignment, exact duplicates and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tagwright.llm import align, exact, runs

TEXT = "doc_id long, text string, lang string, source string, n_chars long"
HARD = [
    None, "", " ", "\n\n", "a", "a a a", " a", "a ", "Ωmega ñ", "x" * 5000, "word " * 3000, "1" * 3000, "😀 ́", "é́",
    "<s> and </s>", "<|endoftext|> <unk> <0x41>", "▁ piece ▁▁", "\x00 zero", "a\u00a0b", "日本語 text", "two  blanks   three",
    "if x:\n\ty = 1\r\n", "ＡＢ", "ﬁne",
]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], TEXT)


def prose(rng, words):
    return " ".join(rng.choice(["the", "river", "sont", "été", "running", "2024", "über", "zx", "a"]) for _ in range(words))


# ---- 11 alignment


def plain_alignment(texts):
    """Groups and links of all texts by comparing every token with every token."""
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letter = align.byte_alphabet()

    def spans(parts):
        out, at = [], 0
        for i, b in parts:
            out.append((i, at, at + len(b)))
            at += len(b)
        return out, b"".join(b for _, b in parts)

    held, docs = Counter(), []
    for t in texts:
        raw = (" " + (t or "")).encode()
        a, raw_a = spans([(i, bytes(letter[c] for c in first.id_to_token(i))) for i in first.encode(raw.decode(), add_special_tokens=False).ids])
        pieces = [(i, second.id_to_piece(i)) for i in second.encode(t or "")]
        byte = re.compile(r"<0x([0-9A-F]{2})>")
        b, raw_b = spans([(i, bytes([int(byte.fullmatch(p)[1], 16)]) if byte.fullmatch(p) else p.replace("▁", " ").encode()) for i, p in pieces])
        if not t or raw_a != raw or raw_b != raw:
            docs.append(None)
            continue
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups = []
        for low, high in zip([0, *cuts], cuts):
            groups.append("|".join(",".join(str(i) for i, p, q in s if low <= p and q <= high) for s in (a, b)))
        docs.append((len(a), len(b), groups, links))
        held.update(set(links))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    rows = []
    for i, d in enumerate(docs):
        if d is None:
            rows.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        best = sum(held[p] == most[p[0]] for p in d[3])
        digest = hashlib.sha256(";".join(d[2]).encode()).hexdigest()
        rows.append((i, d[0], d[1], len(d[2]), len(d[3]), best, sum(held[p] for p in d[3]), digest))
    return rows


@pytest.mark.parametrize("slice_rows", [2_000_000, 7])
def test_alignment_is_that_of_all_token_pairs(spark, slice_rows):
    rng = random.Random(11)
    short = [t if t is None or len(t) < 3000 else t[:300] for t in HARD]
    texts = [*short, *[prose(rng, rng.randint(1, 60)) for _ in range(30)], "the river", "the river"]
    rows = align.align_documents(documents(spark, texts), settings=align.AlignSettings(slice_rows=slice_rows)).collect()
    assert sorted(map(tuple, rows)) == plain_alignment(texts)


def test_bisection_finds_all_shared_cuts():
    rng = random.Random(5)
    for _ in range(300):
        ends_a, ends_b, first_a, first_b, base = [], [], [0], [0], 0
        for _ in range(rng.randint(1, 4)):
            n = rng.randint(0, 40)
            if n:
                ends_a += [base + e for e in sorted({*rng.sample(range(1, n + 1), rng.randint(0, n)), n})]
                ends_b += [base + e for e in sorted({*rng.sample(range(1, n + 1), rng.randint(0, n)), n})]
            first_a.append(len(ends_a))
            first_b.append(len(ends_b))
            base += n
        a, b = align.Sequences([], np.ones(1, int)), align.Sequences([], np.ones(1, int))
        a.ends, b.ends, a.first, b.first = map(np.array, (ends_a, ends_b, first_a, first_b))
        if ends_a:
            assert [ends_a[i] for i in align.shared_cuts(a, b)] == sorted(set(ends_a) & set(ends_b))


def test_alignment_of_empty_tables_and_clashing_names(spark):
    assert align.align_documents(documents(spark, ["x"]).where("doc_id < 0")).count() == 0
    df = spark.createDataFrame([("k", "a b", 1, 2, 3), ("k", "a b", 1, 2, 3)], "name string, body string, row int, pairs int, n int")
    rows = align.align_documents(df, "name", "body").collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0]["name"] == "k"


def test_both_ways_to_encode_give_the_same_ids():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    coded = align.byte_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    texts = [t for t in HARD if t] + ["".join(rng.choice("ab 1'st\n\t \x1c\x85é日ß🙂‍._-A") for _ in range(40)) for _ in range(500)]
    assert coded.encode(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


# ---- 12 exact duplicates


def plain_groups(rows):
    """(id, keep, size, digest) of all rows, and the ids that stay."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    out = []
    for norm, members in groups.items():
        keep = min(members)[1]
        out += [(i, keep, len(members), hashlib.sha256(norm.encode()).hexdigest()) for _, i in members]
    return sorted(out), sorted(min(m)[1] for m in groups.values())


@pytest.mark.parametrize("settings", [exact.NamingSettings(), exact.NamingSettings(block=3), exact.NamingSettings(block=2, hash_bits=7)])
def test_groups_are_those_of_equal_texts(spark, settings):
    rng = random.Random(1)
    base = ["".join(rng.choice("ab \n") for _ in range(rng.randint(0, 9))) for _ in range(120)]
    base += ["x" * 41, "x" * 40, "x" * 40 + " ", "x" * 39 + "y", *HARD[:12]]
    rows = list(enumerate(base))
    found = exact.exact_groups(documents(spark, base), settings=settings).collect()
    groups, kept = plain_groups(rows)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == groups
    assert sorted(r.doc_id for r in found if r.kept) == kept


def test_hashes_that_collide_are_replaced(spark, monkeypatch):
    seeds = set()
    plain = exact._fingerprint
    monkeypatch.setattr(exact, "_fingerprint", lambda b, seed, bits: seeds.add(seed) or plain(b, seed, bits))
    texts = [f"text {i}" for i in range(30)]
    found = exact.exact_groups(documents(spark, texts), settings=exact.NamingSettings(hash_bits=4)).collect()
    assert all(r.kept and r.group_size == 1 for r in found) and len(seeds) > 1


def test_repeated_rows_ties_and_null_ids(spark):
    df = spark.createDataFrame(
        [(1, "a b", 1), (1, "a b", 1), (1, "a  b", 1), (None, "a b  ", 2), (None, "c", 0), (None, None, 0), (7, "", 0)],
        "doc_id long, text string, row int",
    )
    rows = sorted(exact.exact_groups(df).collect(), key=str)
    by = defaultdict(list)
    for r in rows:
        by[r.text_sha256].append(r)
    ab = by[hashlib.sha256(b"ab").hexdigest()]
    assert len(ab) == 4 and {r.group_size for r in ab} == {4} and {r.keep_id for r in ab} == {None} and sum(r.kept for r in ab) == 1
    empty = by[hashlib.sha256(b"").hexdigest()]
    assert {r.keep_id for r in empty} == {7} and len(empty) == 2
    assert exact.exact_groups(df.where("row < 0")).count() == 0


def test_no_python_in_the_plan(spark):
    plan = exact.exact_groups(documents(spark, ["a"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_a_group_of_copies_adds_one_block(spark):
    given = documents(spark, ["same " * 2000] * 300 + ["other"]).selectExpr("doc_id as id", "text")
    rows, names = exact.block_names(given, exact.NamingSettings())
    assert rows.count() == 301 and names.count() == 3  # two full blocks and a rest of one text would be 2, and the other


# ---- 13 periodic runs


def plain_runs(w, least, times):
    """Every maximal stretch of every period, kept if no smaller period holds in it."""
    out, n = [], len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            smaller = any(all(w[k] == w[k + r] for k in range(i, i + size - r)) for r in range(1, q))
            if j > i and size >= max(least, times * q) and not smaller:
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def words_of(rng):
    letters = rng.choice(["a", "ab", "abc", "abcdef"])
    w = [rng.choice(letters) for _ in range(rng.randint(0, 60))]
    if w and rng.random() < 0.6:
        p, a = rng.randint(1, 8), rng.randrange(len(w))
        w = w[:a] + [w[min(a + i % p, len(w) - 1)] for i in range(len(w) + 20)]
    return w


def test_runs_are_all_maximal_stretches():
    rng = random.Random(3)
    for _ in range(1500):
        w = words_of(rng)
        assert runs.all_runs(w) == runs.runs_of(w) == plain_runs(w, 6, 4)
        assert runs.runs_of(w, 2, 2) == plain_runs(w, 2, 2)


def test_automaton_knows_last_ends():
    rng = random.Random(4)
    for _ in range(60):
        w, automaton = words_of(rng), runs.LinkedAutomaton()
        for i, c in enumerate(w):
            last = {}
            for low, high, end in automaton.append({"a": 0, "b": 1, "c": 2, "d": 3, "e": 4, "f": 5}[c]):
                for n in range(low + 1, high + 1):
                    last[n] = end
            for n in range(1, i + 1):
                before = [e for e in range(n - 1, i) if w[e - n + 1 : e + 1] == w[i - n + 1 : i + 1]]
                assert last.get(n, -1) == (before[-1] if before else -1)


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words, 6, 4)
    drop = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    return (doc_id, len(found), *longest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_query_rows_are_those_of_brute_force(spark):
    rng = random.Random(9)
    texts = [*[t if t is None or len(t) < 4000 else t[:600] for t in HARD], "ha " * 50, "\x0b\x0cx\x1cy x\x1cy \u00a0 " * 9]
    texts += [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 90))) for _ in range(200)]
    found = runs.find_runs(runs.with_periods(documents(spark, texts))).collect()
    assert sorted(map(tuple, found)) == [plain_row(i, t) for i, t in enumerate(texts)]


def test_runs_of_empty_tables_null_ids_and_clashing_names(spark):
    df = spark.createDataFrame([(None, "a " * 9, 1, 2), (None, "a " * 9, 1, 2)], "doc_id long, text string, start int, _w int")
    rows = runs.find_runs(runs.with_periods(df)).collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0].length == 9 and rows[0].period == 1
    assert runs.find_runs(runs.with_periods(df.where("start < 0"))).count() == 0


def test_a_very_long_text(spark):
    row = runs.find_runs(documents(spark, ["one two three " * 30_000 + "end"])).first()
    assert (row.n_runs, row.start, row.length, row.period) == (1, 0, 90_000, 3)


def test_forgotten_words_keep_their_ids():
    from tagwright.llm.packing import PackSettings, WordEncoder

    path = PackSettings().tokenizer
    texts = [" ".join(f"word{j % 7} w{i}x{j}, the End." for j in range(300)) for i in range(12)]
    small, large = WordEncoder(path, 10_000), WordEncoder(path, 1 << 30)
    assert [small([t]) for t in [*texts, *texts[:3], ""]] == [large([t]) for t in [*texts, *texts[:3], ""]]
    assert len(small.words) + len(small.before) < len(large.words) / 3  # bounded, whatever has been read
    whole = large.tokenizer.encode(texts[0], add_special_tokens=False).ids
    assert np.frombuffer(small([texts[0]])[0], dtype="<u4").tolist() == whole
