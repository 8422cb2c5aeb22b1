"""The training-data operators against brute force, the tokenizers library, round trips and held-out labels."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tagwright.llm import bpe, common, hamming, langid, neardup, packing, pii, quality, queries, sitetree, urlvocab, wordrules

TEXT = "doc_id long, text string, lang string, source string, n_chars long"
HARD = [None, "", " ", "\n\n", "a", "a a a", "Ωmega ñ", "x" * 5000, "word " * 3000, "1" * 3000, "a@b.c" * 500, "😀 ́"]


def documents(spark, texts, **more):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], TEXT)


# ---- 1 personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    def digits(m):
        return re.sub("[^0-9]", "", m[0])

    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(t) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(t) if 10 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_as_the_patterns_say():
    r = random.Random(1)
    parts = ["1", "2", "25", "7", ".", ".", "-", " ", "+", "(", ")", "@", "a", "b_", "%", "é", "4111111111111111", "\n", "1.2.3.4", "x@y.z", "+1 (017) 555-7713"]
    for _ in range(20000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(25)))
        assert pii.base_spans(t) == plain_spans(t)


@pytest.fixture(scope="module")
def field():
    return pii.SpanField(12).fit(pii.template_examples(7), 6, 0.3, 7)


def test_field_finds_what_patterns_miss(field):
    base, spans = pii.all_spans("call me: (317) 555-0188 or write to jo.do @ mail.org, build 20210304", field)
    assert base == []
    assert [k for k, _, _ in spans] == ["phone", "email"]
    held = pii.template_examples(99, 200)
    assert np.mean([field.best(t) == s for t, s in held]) > 0.9


def test_field_gradient_is_that_of_the_likelihood(field):
    text, spans = next(e for e in pii.template_examples(5) if e[1])
    cut, segments = field.segments(text)
    scores = [field.scores(f) for _, _, f in segments]
    n = len(cut) - 1
    a, b = field.forward(n, segments, scores), field.backward(n, segments, scores)
    z = np.logaddexp(a[n, 0], a[n, 1])
    assert b[0, 0] == pytest.approx(z)


def test_spans_of_hard_texts(spark, field):
    rows = pii.find_spans(documents(spark, HARD + ["a@b.co", "a@b.co"]), field).orderBy("doc_id").collect()
    assert [r.n_email for r in rows[-2:]] == [1, 1]
    assert rows[0].base_sha256 == hashlib.sha256(b"").hexdigest() and rows[0].spans == ""
    for r, t in zip(rows, HARD):
        want = ",".join(f"{k}:{s}:{e}" for k, s, e in plain_spans(t or ""))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))


def test_masked():
    assert pii.masked("to a@b.co now", [("email", 3, 9)]) == "to [EMAIL] now"


# ---- 2 quality

GOOD = ["The quick brown fox went home.\nIt was late and the road was long.", "Rain fell on the town all day, and nobody minded."]
BAD = ["BUY!! NOW!! GO!! ###\n$$$ &&& ***", "buy buy buy buy buy buy\nnow now now now"]


def test_scores_of_lines_are_those_of_all_features_at_once():
    r = np.random.default_rng(6)
    d = quality.N_BASE
    field = quality.LineField(r.normal(size=d), 1 + r.random(d), r.normal(size=3 * d + 3) / 4, r.normal(size=(2, 2)))
    texts = ["", "one", "a b\n\nc d e.\n", "x\n" * 700, "\n", "last, line\nof 3"]
    x, length, first = quality.line_features(texts)
    x = quality.with_neighbours((x - field.mean) / field.scale, first)
    emission, lengths, begins = field.lines(texts)
    assert np.allclose(emission, x @ field.weights) and (lengths == length).all() and (begins == first).all()
    good = quality.forward_backward(emission, field.pair, first)[0]
    assert np.allclose(quality.marginals(emission, field.pair, first), good)


def test_lines_are_cut_only_between_lines(monkeypatch):
    monkeypatch.setattr(quality, "STEP_LINES", 3)
    texts = ["a\nb\nc\nd\n", "", "\n\n\n", "e", "f\ng\nh"]
    back = [b"" for _ in texts]
    for run, owners in quality.line_runs(texts):
        assert sum(t.count(b"\n") + 1 for t in run) <= 3
        for t, i in zip(run, owners):
            back[i] += t + b"\n"
    assert [t[:-1].decode() for t in back] == texts


def test_memory_of_short_lines_is_bounded():
    import tracemalloc

    d = quality.N_BASE
    field = quality.LineField(np.zeros(d), np.ones(d), np.ones(3 * d + 3), np.zeros((2, 2)))
    tracemalloc.start()
    field.score(["a\n" * 1_000_000, *["b\n" * 1000] * 1000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 << 20  # 3 million lines


def test_forward_backward_is_the_sum_over_all_labellings():
    r = np.random.default_rng(0)
    e, pair, first = r.normal(size=6), r.normal(size=(2, 2)), np.array([0, 4, 5, 6])
    good, expected = quality.forward_backward(e, pair, first)
    total = np.zeros((2, 2))
    for a, b in zip(first, first[1:]):
        weights, seen = {}, np.zeros(b - a)
        for code in range(2 ** (b - a)):
            y = [code >> i & 1 for i in range(b - a)]
            weights[tuple(y)] = np.exp(sum(e[a + i] * y[i] for i in range(b - a)) + sum(pair[u, v] for u, v in zip(y, y[1:])))
        z = sum(weights.values())
        for y, w in weights.items():
            seen += np.asarray(y) * w / z
            for u, v in zip(y, y[1:]):
                total[u, v] += w / z
        assert good[a:b] == pytest.approx(seen)
    assert expected == pytest.approx(total)


def test_quality_learns_and_scores_hard_texts(spark):
    r = random.Random(4)
    rows = [(" ".join(r.sample(x.split(" "), len(x.split(" ")))), q) for _ in range(60) for x, q in [(t, 1) for t in GOOD] + [(t, 0) for t in BAD]]
    model = quality.fit_lines(rows)
    assert (model.score(GOOD) > 0.7).all() and (model.score(BAD) < 0.3).all()
    out = quality.score_documents(documents(spark, HARD), model).collect()
    assert len(out) == len(HARD) and all(0 <= x.score <= 1 for x in out)
    assert quality.fit_lines([]).score(["a", ""]) == pytest.approx([0.5, 0.5])
    kept = quality.keep_good(documents(spark, [*GOOD, *BAD]), model)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and kept.count() == 2


# ---- 3 language


def test_language(spark):
    rows = [("the house is on the hill and the dog " * 3, "en"), ("das haus ist auf dem berg und der hund " * 3, "de")] * 30
    model = langid.fit_language(rows)
    out = langid.identify(documents(spark, [*HARD, "12 !", "the dog", "der hund"]), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in out[:4]] == ["und"] * 4 and out[-3].lang_pred == "und" and out[-3].score == 0
    assert [r.lang_pred for r in out[-2:]] == ["en", "de"]
    none = langid.fit_language([])
    assert none.predict(["the"])[0] == ["und"]


def invented(rng, syllables, words):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(words))


SYLLABLES = {"a": ["th", "er", "ing", "and", "on", "es"], "b": ["ach", "ung", "sch", "ei", "en", "ver"], "c": ["ión", "ado", "qu", "ez", "la", "os"],
             "d": ["wsz", "ęć", "ło", "rzy", "ką", "dzi"]}


def test_a_language_that_was_left_out_is_rejected(spark):
    rng = random.Random(7)
    texts = {k: [invented(rng, v, rng.randint(5, 150)) for _ in range(150)] for k, v in SYLLABLES.items()}
    model = langid.fit_language([(t, k) for k in "abc" for t in texts[k][:100]])
    known = [(t, k) for k in "abc" for t in texts[k][100:]]
    out = langid.identify(documents(spark, [t for t, _ in known]), model).orderBy("doc_id").collect()
    assert sum(r.lang_pred == k and not r.rejected for r, (_, k) in zip(out, known)) >= 0.98 * len(known)
    far = langid.identify(documents(spark, [t for t in texts["d"] if len(t) > 200]), model).collect()
    assert sum(r.rejected for r in far) >= 0.8 * len(far) and len(far) > 50
    left = langid.keep_identified(documents(spark, [texts["a"][120], None, "123", *texts["d"][:5]]), model)
    assert 0 in [r.doc_id for r in left.collect()] and 1 not in [r.doc_id for r in left.collect()]


def test_scores_are_plain_means_of_subword_scores():
    model = langid.fit_language([("the house and the dog", "en"), ("das haus und der hund", "de")] * 20)
    for text in ["The dog", "a", "x1y", "Der Hund, das Haus!", "é ñ"]:
        c = [0, *[ord(x.lower()) if x.isalpha() else 0 for x in text], 0, 0, 0, 0]
        total, n = np.zeros(2), 0
        for i in range(len(c) - 4):
            if c[i + 1]:  # runs count by their second character
                for size in (2, 3, 4):
                    hashed, _, _ = langid.grams(["".join(chr(x) if x else " " for x in c[1:])], model.bits)
                    total += model.table[:, hashed[size - 2][i]]
                    n += 1
        z, letters = model.logits([text])
        assert np.allclose(z[0], total / max(n, 1) + model.offset, atol=1e-5) and letters[0] == sum(x.isalpha() for x in text)


# ---- 4 search


def test_top_k_is_that_of_all_pairs(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(6, 64))
    rows = [(i, (base[i % 6] + r.normal(size=64)).tolist()) for i in range(150)] + [(200 + i, base[0].tolist()) for i in range(30)]
    rows += [(300, None), (350, [float("nan"), 1.0, None]), (400, []), (0, rows[0][1])]
    codes = hamming.sign_codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    plain = {x.id: x.code & (1 << 64) - 1 for x in codes.collect()}
    assert 300 not in plain and plain[400] == 0 and plain[350] == 2
    got = hamming.top_k(codes, codes.where("id % 50 = 0")).collect()
    for q in [i for i in plain if i % 50 == 0]:
        want = sorted((bin(plain[q] ^ c).count("1"), i) for i, c in plain.items() if i != q)[:10]
        assert [(x.distance, x.neighbor_id) for x in sorted(got) if x.query_id == q] == want
    assert hamming.top_k(codes.limit(0), codes.limit(0)).count() == 0


def test_long_vectors_are_not_cut(spark):
    rows = spark.createDataFrame([(1, [1.0] * 64), (2, [1.0] * 65)], "vec_id long, embedding array<double>")
    assert hamming.sign_codes(rows.where("vec_id = 1")).first().code == -1
    with pytest.raises(Exception, match="more than 64 values"):
        hamming.sign_codes(rows).collect()


# ---- 5 pages


def test_main_text():
    page = (
        "<html><head><title>T</title></head><body><header><h1>Site</h1></header><div class='cookie-notice'>we use</div><main>"
        "<h1>Title &amp; x</h1><p>One\n <b>two</b><p>three<ul><li>a<li>b</ul><form><p>q</p></form><section class=\"comments\"><p>c</p>"
        "</section></main><aside>s</aside><script>if(a<b){'</p>'}</script><p>outside</body>"
    )
    assert sitetree.main_text(page, set()) == ["Title & x", "One two", "three", "a", "b"]
    assert sitetree.main_text("<p>a<p>b &nbsp; c<div>d", set()) == ["a", "b c", "d"]
    assert sitetree.main_text("", set()) == [] and sitetree.main_text("a < b <", set()) == ["a < b <"]


@pytest.mark.parametrize("wrap", ['div class="content has-sidebar"', 'main class="no-sidebar"', 'div id="search-results"', "div class=page-with-header", "article class='post sidebar'", "section class=widget"])
def test_classes_of_wrappers_remove_nothing(wrap):
    assert sitetree.main_text(f"<body><{wrap}><p>text</p></{wrap.split()[0]}></body>", set()) == ["text"]


def test_classes_of_roles():
    for name in ("ad", "site-header", "ad-slot-3", "x cookie-notice", "main_nav", "comment-list"):
        assert sitetree.main_text(f"<div class='{name}'><div><p>a</p></div></div><p>b", set()) == ["b"]
    page = "<div class=header>x<div id=search><article><p>a</p><div class=ad>b</div></article></div></div><div class=header>c</div>"
    assert sitetree.main_text(page, set()) == ["a"]
    assert sitetree.main_text("<aside class=ad><article>a</article></aside><p>b", set()) == ["b"]


def test_style_tree_removes_what_a_site_repeats(spark):
    rows = [(i, f"http://h.org/{i}", f"<body><div class=x><p>same on all</p></div><div class=y><p>page {i} says {i * i}</p></div></body>") for i in range(12)]
    rows += [(20, "http://h.org/a", None), (21, None, "<p>alone"), (22, "http://one.org/", "<div class=x><p>same on all</p></div>")]
    pages = spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string")
    out = {r.page_id: r for r in sitetree.extract(pages).collect()}
    assert out[3].text == "page 3 says 9" and out[20].text == "" and out[21].text == "alone" and out[22].text == "same on all"
    copies = spark.createDataFrame([(i, "http://c.org/", "<article><p>same</p></article>") for i in range(12)], pages.schema)
    assert {r.text for r in sitetree.extract(copies).collect()} == {"same"}


def test_style_tree_acts_on_pages_with_an_article(spark):
    box, other = "<div class=more><p>read this also</p></div>", "<div class=t>outside page {0} tells {0}</div>"
    page = "<body>" + other + "<div class=s>seen everywhere</div><article>Root<h1>Title of {0}</h1><p>page {0} says {0} and more of {0}</p>" + box + "</article></body>"
    near = "<article><h1>One title</h1><p>" + " ".join(f"w{i}" for i in range(2000)) + " {0}</p></article>"
    rows = [(i, "http://h.org/", page.format(i * i)) for i in range(12)] + [(100 + i, "http://n.org/", near.format(i)) for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r.text for r in sitetree.extract(pages).collect()}
    assert all(out[i] == f"outside page {i * i} tells {i * i}\n\nRoot\n\nTitle of {i * i}\n\npage {i * i} says {i * i} and more of {i * i}" for i in range(12))
    assert all(out[100 + i].startswith("One title\n\nw0 w1") for i in range(12))
    none = sitetree.extract(pages, settings=sitetree.TreeSettings(threshold=-1.0)).where("page_id = 3").first()
    assert "read this also" in none.text


# ---- 6 addresses


def test_urls(spark):
    rows = ["http://M.Casino-win.example.com/x", "http://casinos.org/", "http://a.org/free-bets", "http://a.org/free", None, "", "no", "http://x.example.com/en/71?a#b", "http://com/en/", "http://xcom/en/"]
    out = urlvocab.judge_urls(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")).orderBy("page_id").collect()
    assert [r.verdict for r in out] == ["block", "allow", "block", "allow", "allow", "allow", "allow", "allow", "block", "allow"]
    assert (out[7].host, out[7].path, out[7].rule) == ("x.example.com", "/en/71", "example.com/en/7") and out[4].host == ""


def test_rules_are_those_of_the_contract():
    assert dict(urlvocab.RULES) == {
        "com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"
    }
    judge, sql = urlvocab.UrlJudge(urlvocab.UrlVocabulary()), urlvocab.verdict_sql()
    for host, path, rule, verdict in [
        ("a.org", "/es/1", "org/es/", "block"), ("org", "/es/", "org/es/", "block"), ("a.org", "/es", None, "allow"),
        ("b.net", "/de/poker-bet", "net/de/", "allow"), ("x.example.net", "/de/81", "example.net/de/8", "block"),
        ("example.com", "/en/7casino", "example.com/en/7", "allow"), ("example.com", "/en/8", "com/en/", "block"),
    ]:
        assert judge(f"http://{host}{path}")[:4] == (host, path, rule, verdict)
        assert rule is None or f"when rule = '{rule}' then '{verdict}'" in sql


def test_weights_decide_between_pairs_of_soft_terms():
    judge = urlvocab.UrlJudge(urlvocab.UrlVocabulary())
    urls = {"http://a.b/win-free": "allow", "http://a.b/win-bet": "block", "http://a.b/bet-poker": "block", "http://a.b/win-free-click": "block",
            "http://a.b/bet-bet": "allow", "http://a.b/poker": "allow", "http://a.b/casino": "block", "http://a.b/" + "free-" * 20000: "allow"}
    assert {u: judge(u)[3] for u in urls} == urls


# ---- 7 rules


def plain_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often, inside = Counter(windows), set()
    for i, x in enumerate(windows):
        if often[x] > 1:
            inside.update(range(i, i + 5))
    seen, again = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(inside)


def test_rule_counts(spark):
    r = random.Random(2)
    parts = ["a ", "b ", "a b c d e ", "\n", "é\x85", "\x1c", "#", "<", " ", "x\n", "\xa0"]
    for _ in range(5000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(30)))
        assert wordrules.counts(t) == plain_counts(t)
    model = wordrules.fit_ngrams([(t, q) for t, q in [*((x, 1) for x in GOOD), *((x, 0) for x in BAD)]] * 20)
    assert model.score(GOOD).min() > model.score(BAD).max()
    out = wordrules.judge(documents(spark, HARD), model).orderBy("doc_id").collect()
    assert [tuple(x[1:6]) for x in out] == [plain_counts(t or "") for t in HARD]
    assert out[0].base_failed and not out[0].kept


# ---- 8 packing


def test_packing_covers_every_id_once(spark):
    r = random.Random(5)
    texts = [*HARD, *(" ".join(r.choice(["The", "cat's", "sat,", "4ever", "<|endoftext|>"]) for _ in range(r.randrange(6000))) for _ in range(40))]
    rows = packing.pack(documents(spark, texts).coalesce(2), with_ids=True).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for x in rows:
        pieces.setdefault(x.doc_id, []).append(x)
        assert zlib.crc32(np.asarray(x.ids, dtype="<u4").tobytes()) == x.ids_crc32
    for i, t in enumerate(texts):
        whole = library.encode(t or "", add_special_tokens=False).ids + [1]
        own = sorted(pieces[i], key=lambda x: x.start)
        assert [n for x in own for n in x.ids] == whole
        assert all(x.doc_tokens == len(whole) for x in own)
        assert [x.start for x in own] == list(np.cumsum([0, *(x.length for x in own[:-1])]))
    sequences = {}
    for x in rows:
        sequences.setdefault(x.sequence_id, []).append(x)
    for s in sequences.values():
        s.sort(key=lambda x: x.offset)
        size = sum(x.length for x in s)
        assert size <= 2048 and size & size - 1 == 0  # nothing is padded
        assert [x.offset for x in s] == list(np.cumsum([0, *(x.length for x in s[:-1])]))


def test_costs_are_balanced():
    s = packing.PackSettings(capacity=64)
    held, left = packing.place([packing.Piece(i, b"", 0, n) for i, n in enumerate([40, 30, 20, 10, 10, 10, 8])], 2, s)
    assert [sum(p.length for p in h) for h in held] == [64, 64] and not left
    assert packing.place([], 0, s) == ([], [])


# ---- 9 near duplicates


def plain_set(t, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def plain_groups(texts, k, percent):
    sets, group = [plain_set(t, k) for t in texts], list(range(len(texts)))
    for _ in texts:
        before = list(group)
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= percent * len(x | y):
                    group[i] = group[j] = min(group[i], group[j])
        if group == before:
            return [len(s) for s in sets], group


@pytest.mark.parametrize("s", [neardup.NearSettings(), neardup.NearSettings.at_80()])
def test_groups_are_those_of_all_pairs(spark, s):
    r = random.Random(8)
    base = [[r.choice("abcdefghij") + str(r.randrange(60)) for _ in range(n)] for n in (200, 60, 12)]
    texts = [*HARD[:8], "", None, "One two", "one TWO"]
    for words in base:
        for _ in range(25):
            copy = list(words)
            for _ in range(r.randrange(4)):
                copy[r.randrange(len(copy))] = "new" + str(r.randrange(40))
            texts.append(" ".join(copy))
    out = neardup.near_duplicates(documents(spark, texts), settings=s).orderBy("doc_id").collect()
    sizes, group = plain_groups(texts, s.words, s.percent)
    assert [x.n_shingles for x in out] == sizes
    assert [x.component_id for x in out] == group
    assert all(x.kept == (x.doc_id == x.component_id) for x in out)
    left = neardup.drop_near_duplicates(documents(spark, texts), settings=s)
    assert sorted(x.doc_id for x in left.collect()) == sorted(set(group))


@pytest.mark.parametrize("s", [neardup.NearSettings(), neardup.NearSettings(share=3)])
def test_repeated_rows_and_several_sets_of_an_id_in_torn_bands(spark, s):
    """A and B are linked by 92 of 108 shingles; the leaders of their bands are linked with neither."""
    rows, group = [], {}
    for k in range(12):
        core, first = [f"c{k}w{i}" for i in range(94)], 1000 * (k + 1)
        a, b = (" ".join(core + [f"{x}{k}w{i}" for i in range(8)]) for x in "ab")
        rows += [(first, a), (first + 1, b)]
        rows += [(first, a)] if k % 2 else [(first, " ".join(f"z{k}w{i}" for i in range(40)))]  # again, or another set of it
        group |= {first: first, first + 1: first}
        for f in range(6):
            for i in range(5):
                own = [f"l{k}f{f}w{j}" for j in range(8)] + [f"l{k}f{f}i{i}"]
                rows.append((first + 10 * (f + 1) + i, " ".join(core[:93] + own)))
                group[rows[-1][0]] = first + 10 * (f + 1)
    sets = [(i, plain_set(t)) for i, t in rows]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], TEXT)
    out = neardup.near_duplicates(df, settings=s).collect()
    linked_ = {(i, j) for i, x in sets for j, y in sets if i < j and 100 * len(x & y) >= 85 * len(x | y)}
    assert all((group[i] == group[j]) == ((i, j) in linked_) for i in group for j in group if i < j)
    assert sorted((r.doc_id, r.n_shingles) for r in out) == sorted((i, len(s)) for i, s in sets)
    assert {(r.doc_id, r.component_id) for r in out} == set(group.items())


def test_sketch_agrees_as_often_as_sets_do():
    r = np.random.default_rng(3)
    common_, one, two = (r.integers(1, 2**63, n, dtype=np.uint64) for n in (300, 50, 50))
    value, start = np.concatenate([common_, one, common_, two]), np.array([0, 350, 700, 700])
    c = neardup.sketch(value, start, 120)
    assert (c[:2] != 0).all()
    assert (c[0] == c[1]).mean() == pytest.approx(0.75, abs=0.13)


def test_components(spark):
    r = random.Random(1)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + r.randrange(1, 50)) for _ in range(30)] + [(7, 7)]
    got = {x.id: x.component for x in neardup.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(v == 100 for k, v in got.items() if k >= 100)


# ---- 10 byte-pair encoding


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def test_tokens_are_those_of_the_library(codec):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(3)
    parts = ["aa", "a", "<|endoftext|>", " ", "\n", "the ", "'ll", "  ", "ing", "000", "=====", "\x1c", "\x85", "é", "中", "😀", "Thandtion"]
    for t in [*(x or "" for x in HARD), *("".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(4000))]:
        ids = codec.encode(t)
        assert np.frombuffer(ids, dtype="<u4").tolist() == library.encode(t, add_special_tokens=False).ids
        assert codec.decode(ids) == t


def test_automaton_of_few_merges():
    label = {0: b"a", 1: b"b", 2: b"aa", 3: b"ab", 4: b"aab"}
    tokens = bpe.TokenAutomaton(label, [(0, 0), (0, 1), (2, 1)], [2, 3, 4])
    table = bpe.ByteTable(tokens)
    assert table.encode(b"aaa") == [2, 0] and table.encode(b"aab") == [4] and table.encode(b"aaab") == [2, 3]
    assert table.encode(b"") == [] and not tokens.arc(0, 0) and tokens.arc(2, 0)


def test_digests_of_hard_texts(spark):
    rows = bpe.encode_digests(documents(spark, HARD)).orderBy("doc_id").collect()
    assert [x.decoded_sha256 for x in rows] == [hashlib.sha256((t or "").encode()).hexdigest() for t in HARD]
    assert rows[0].n_tokens == 0


# ---- all


def test_empty_tables_and_extra_columns(spark, tmp_path):
    from pyspark.sql import functions as F

    folder = str(tmp_path)
    shapes = {
        "documents": TEXT + ", n long, score double, id long, component string", "labels": "doc_id long, quality int, toxic int",
        "pages": "page_id long, url string, html string, host string, path string", "embeddings": "vec_id long, embedding array<float>, code string",
    }
    for name, shape in shapes.items():
        spark.createDataFrame([], shape).write.parquet(f"{folder}/{name}.parquet")
    for name, q in queries.QUERIES.items():
        assert q(spark, folder).count() == 0, name
    wide = documents(spark, ["a b c d", None]).withColumns({c: F.lit(1) for c in ("_id", "_text", "id", "h1", "n", "name", "band")})
    assert neardup.near_duplicates(wide).count() == 2
    assert neardup.drop_near_duplicates(wide).columns == wide.columns


def test_words_are_hashed_alike_wherever_they_stand():
    a, b = common.Words([b"x yy", b"", b" yy\nx "]), common.Words([b"yy", b"x"])
    assert a.hashes[[0, 1]].tolist() == b.hashes[[1, 0]].tolist() == a.hashes[[3, 2]].tolist()
    assert a.first.tolist() == [0, 2, 2, 4]
