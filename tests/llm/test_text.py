"""Operators on texts against brute force: formatting, quality, fingerprints, BPE, packing, toxicity, URLs, WARC."""

import hashlib
import random
import re
import zlib
from array import array

import numpy as np
import pytest

pytest.importorskip("quillon.llm")

from quillon.llm import bpe, chat, fingerprint, packing, quality, toxicity, urlfilter, warc  # noqa: E402
from quillon.llm.common import with_key  # noqa: E402

public_tokenizers = pytest.importorskip("public_tokenizers")

ODD = ["", None, "a", "É é  ß ﬁ", "x" * 3000, "the the the the the the the the the the the", "Line one here\nLine one here\n\n \nΣΑΣ", "tab\tand\x0bmore\x1cend", "<|endoftext|> [INST] </s> \\ \\\\ [\\INST]", "日本語 テキスト 🙂"]


def documents(spark, texts, extra=False):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    if extra:
        for c in ("score", "bucket", "key", "kept", "tie", "component"):
            df = df.selectExpr("*", f"'x' AS {c}")
    return df


# chat


def test_escaping_is_reversible():
    rng = random.Random(0)
    f = chat.escaper(chat.CONTROLS)
    for _ in range(500):
        t = "".join(rng.choice(["\\", "[INST]", "</s>", "[", "INST]", "/", "s>", "<", "<s>", "a", "\n", "[/INST]"]) for _ in range(rng.randrange(9)))
        e = f(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROLS)


def test_template_language():
    t = chat.Template("{% set x = 'a' + 'b' %}{% if x == 'ab' and not false %}{{ x | upper }}{% else %}no{% endif %}{% for m in messages %}{{ loop.index }}{{ m['text'] | trim }}{% if not loop.last %},{% endif %}{% endfor %}!")
    msgs = [{"role": "user", "text": " p "}, {"role": "assistant", "text": "q"}]
    assert t.render(msgs)[0] == "AB1p,2q!"
    assert not chat.Template("{{ messages | length }}{% for m in messages %}.{% endfor %}").streams
    assert len(chat.Template("a{{ 'b' + 'c' }}{% if true %}d{% endif %}").tree) == 1
    one, spans = chat.Template(chat.TEMPLATE).render(msgs)
    assert [one[a:b] for a, b in spans] == ["q"] and "".join(x for x, _ in chat.Template(chat.TEMPLATE).pieces(msgs)) == one
    for bad in ("{{ m.__class__( }}", "{% for x %}", "{% if a %}", "{{ a | eval }}", "{{ x[y] }}", "{% import os %}"):
        with pytest.raises(chat.TemplateError):
            chat.Template(bad)
    for bad in ("{{ unknown }}", "{{ 'a'.upper }}"):
        with pytest.raises(chat.TemplateError):
            chat.Template(bad).render([])


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", chat.INJECTED), (1, 1, "assistant", "x\\</s>y"), (1, 2, "sys[END]tem", "z"), (None, None, None, None), (2, 1, "assistant", "b"), (2, 0, "assistant", ""), (3, 5, "user", "dup"), (3, 5, "user", "dup")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(chat.formatted(df.selectExpr("*", "1 AS piece"))).collect()}
    for conv in (1, 2, 3, None):
        own = sorted(((t or -1, r or "", x or "") for c, t, r, x in turns if c == conv))
        loss = "".join(x for _, r, x in own if r == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(own) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{x}\n" for _, a, x in own).encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digests(chat.formatted(df.limit(0))).count() == 0


# quality


def brute_quality(text):
    ws, words, cur = " \t\n\x0b\x0c\r", [], ""
    for c in (text or "") + " ":
        if c in ws:
            words += [cur] if cur else []
            cur = ""
        else:
            cur += c
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    cover = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
    lines, dup = (text or "").split("\n"), 0
    for i, line in enumerate(lines):
        dup += any(c not in ws for c in line) and line in lines[:i]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(cover)


def test_quality_counts():
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(["a ", "b ", "c\n", "# ", "é\t", "b\n"]) for _ in range(rng.randrange(60))) for _ in range(150)]
    for t in texts:
        assert quality.measure(t)[:5] == brute_quality(t)
    big = [f"w{rng.randrange(9000)}" for _ in range(12_000)]
    big[100:110] = big[5000:5010]
    ids = {w: i for i, w in enumerate(dict.fromkeys(big))}
    grams: dict = {}
    for i in range(len(big) - 4):
        grams.setdefault(tuple(big[i : i + 5]), []).append(i)
    want = {i + j for at in grams.values() if len(at) > 1 for i in at for j in range(5)}
    assert quality.repeated(np.array([ids[w] for w in big])) == len(want)


def test_quality_verdicts(spark):
    rng = random.Random(1)
    good = [" ".join(rng.choice(quality.COMMON["en"] + ["house", "river", "stone."]) + f"{rng.randrange(99) or ''}" * (rng.random() < 0.02) for _ in range(200)) for _ in range(30)]
    junk = "%%% ### $$$ *** &&& ||| <<<" + " ".join(rng.choice("%#$*&|<>") * 3 + str(rng.random()) for _ in range(200))
    docs = documents(spark, [*good, junk, *ODD], extra=True).drop("kept")
    got = {r["doc_id"]: r for r in quality.judged(docs.select("doc_id", "lang", "text"), ["doc_id"]).collect()}
    assert all(got[i]["kept"] for i in range(30)) and not got[30]["kept"] and not got[30]["base_failed"]
    assert got[31]["n_words"] == 0 and got[31]["base_failed"]
    left = quality.filtered(docs)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {i for i, r in got.items() if r["kept"]}
    assert quality.judged(docs.select("doc_id", "lang", "text").limit(0), ["doc_id"]).count() == 0
    p = np.array([1.0, 1, 0])
    assert quality.jensen_shannon(p, p) == 0 and quality.jensen_shannon(np.array([1.0, 0]), np.array([0, 1.0])) == 1


def test_quality_rare_and_null_languages(spark):
    rng = random.Random(5)
    prose = lambda words: " ".join(rng.choice(words) for _ in range(200))
    often, made = quality.COMMON["en"][:20] + ["house", "river"], [a + b for a in ("zor", "vek", "lum", "tas", "quib") for b in ("", "an", "ild", "omm", "urg", "esk")]
    rows = [(3 * i + j, prose(often), f"l{i:02}") for i in range(66) for j in range(3)]
    rows += [(200 + i, prose(made), f"r{i}") for i in range(4)]
    rows += [(300, prose(made), None), (301, prose(often), None), (302, "%#$ &|<> " * 60, None)]
    rows += [(400, " ".join(rng.choice("%#$&|<>") * 3 + str(rng.random()) for _ in range(200)), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    want = {r[0] for r in rows} - {302, 400}
    got = quality.judged(docs, ["doc_id"]).collect()
    assert len(got) == len(rows) and {r["doc_id"] for r in got if r["kept"]} == want
    by_blocks = quality.judged(docs, ["doc_id"], held=8)
    assert sorted(map(tuple, by_blocks.collect())) == sorted(map(tuple, got))
    for held in (quality.HELD, 8):
        left = quality.filtered(docs, held=held)
        assert left.columns == docs.columns and sorted(map(tuple, left.collect())) == sorted(r for r in rows if r[0] in want)
    unnamed = docs.filter("lang is null")
    assert quality.judged(unnamed, ["doc_id"]).count() == 4


def test_quality_word_limit_falls_with_length(spark):
    rng = random.Random(7)
    made = [a + b + c for a in ("zor", "vek", "lum", "tas", "quib") for b in ("an", "ild", "omm", "urg", "esk") for c in ("a", "o", "er", "ish")]
    prose = lambda n, share: " ".join(rng.choice(quality.COMMON["en"] if rng.random() < share else made) for _ in range(n))
    texts = [prose(1500, 0.4) for _ in range(30)] + [prose(n, 0.4) for n in (50, 150, 200, 300) for _ in range(5)] + [prose(1500, 0.1)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality.judged(docs, ["doc_id"]).collect()}
    assert 0.22 < got[50]["word_distance"] < quality.Limits().words and not got[50]["kept"] and not got[50]["base_failed"]
    assert all(got[i]["kept"] for i in range(50))
    assert {r["doc_id"] for r in quality.filtered(docs).collect()} == set(range(50))


# fingerprints


@pytest.mark.parametrize("ids", ["plain", "odd"])
def test_fingerprints(spark, ids):
    texts = ODD + ["ﬁne  Text ", "FINE text", "same", "same", "last one"]
    docs = documents(spark, texts, extra=True)
    if ids == "odd":
        docs = docs.selectExpr("CASE WHEN doc_id = 3 THEN NULL WHEN doc_id = 5 THEN 4 ELSE doc_id END AS doc_id", "text")
        found = fingerprint.compared(docs).collect()
        assert len(found) == len(texts) and sorted(r["n_chars"] for r in found) == sorted(len(t or "") for t in texts)
        return
    got = {r["doc_id"]: r for r in fingerprint.compared(docs).collect()}
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        e, r = fingerprint.edit(t, nxt), got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprint.fingerprint(t), fingerprint.fingerprint(e))
        assert r["near_edited"] == (fingerprint.canonical(t) == fingerprint.canonical(e)) and r["near_next"] == (fingerprint.canonical(t) == fingerprint.canonical(nxt))
    assert got[10]["fingerprint"] == got[11]["fingerprint"] != got[12]["fingerprint"]
    groups = {r["doc_id"]: r["first_id"] for r in fingerprint.grouped(docs).collect()}
    assert groups[11] == 10 and groups[13] == 12 and groups[1] == 0
    assert fingerprint.compared(docs.limit(0)).count() == 0


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    docs = documents(spark, ["aa", "bb", "aa", "c", "bb", None])
    monkeypatch.setattr(fingerprint, "GROUP", 2)
    got = {r["doc_id"]: r for r in fingerprint.compared(docs, digest=lambda b: "0" * 32).collect()}
    prints = {i: r["fingerprint"] for i, r in got.items()}
    assert prints[0] == "0" * 32 and prints[1] == prints[4] == f"{'0' * 32}-{prints[1].split('-')[1]}" and prints[2] == prints[0]
    assert len(set(prints.values())) == 4 and prints[3].startswith("0" * 32 + "-")


def brute_fingerprints(docs):
    """By the definition, from the standard library only: canonical texts, edits and which fingerprints are equal."""
    import unicodedata

    ordered = sorted(docs)
    out = {}
    for k, (i, t) in enumerate(ordered):
        t, nxt = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(t) // 2
        e = "".join([*t[: len(t) - half], *nxt[:half]])
        fold = [" ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", x).casefold()).split()) for x in (t, e, nxt)]
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), fold[0], fold[1], float(fold[0] == fold[1]), float(fold[0] == fold[2]))
    return out


def test_fingerprints_equal_brute_force(spark):
    rng = random.Random(15)
    texts = ["".join(rng.choice(["a", "A", " ", "  ", "ß", "SS", "ﬁ", "fi", "é", "e\u0301", "Σ", "\u00a0", "①"]) for _ in range(rng.randrange(6))) for _ in range(300)] + ["same"] * 40 + [None]
    docs = [(3 * i + rng.randrange(3), t) for i, t in enumerate(texts)]
    rng.shuffle(docs)
    want = brute_fingerprints(docs)
    got = {r["doc_id"]: r for r in fingerprint.compared(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    assert {i: (r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for i, r in got.items()} == {i: (w[0], w[1], w[4], w[5]) for i, w in want.items()}
    by_text: dict = {}
    for i, w in want.items():
        by_text.setdefault(w[2], set()).add(got[i]["fingerprint"])
        by_text.setdefault(w[3], set()).add(got[i]["edited_fingerprint"])
    assert all(len(x) == 1 for x in by_text.values()) and len({next(iter(x)) for x in by_text.values()}) == len(by_text)


# BPE


def test_bpe_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(5)
    texts = ODD + ["don't I'LL we've 12345 aaaaaaaa", "<|startoftext|>a<|endoftext|>", "İstanbul ǅ ½ e\u0301"] + ["".join(rng.choice("abcdeé' .,1\n") for _ in range(80)) for _ in range(200)]
    got = {r["doc_id"]: r for r in bpe.encode_decode(documents(spark, texts, extra=True), path).collect()}
    digests = {r["doc_id"]: r for r in bpe.digests(documents(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        assert got[i]["ids"] == ids and got[i]["decoded"] == text
        assert digests[i]["ids_sha256"] == hashlib.sha256(array("I", ids).tobytes()).hexdigest() and digests[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest() and digests[i]["n_tokens"] == len(ids)
    assert bpe.digests(documents(spark, texts).limit(0), path).count() == 0


# packing


def test_packing(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(6)
    texts = ODD + ["two  spaces   three", " lead", "trail ", "a \n b", "x <|endoftext|>y"] + [" ".join(rng.choice(["alpha", "beta", "gamma\n", "it's", "δέλτα", "9"]) for _ in range(rng.randrange(900))) for _ in range(40)]
    docs = documents(spark, texts + [texts[-1]] * 5, extra=True)
    found = packing.packed(docs, path).collect()
    by_doc: dict = {}
    for r in found:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts + [texts[-1]] * 5):
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    sequences: dict = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024 and at & (at - 1) == 0
    assert packing.packed(docs.limit(0), path).count() == 0


def test_token_ids_of_all_white_space(monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, coder, rng = tokenizers.Tokenizer.from_file(path), packing.ByteEncoder(path), random.Random(2)
    white = [chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]
    letters = white + [" "] * 20 + [*"ab'sétIL1½²٣,.!-日🙂\u0301<|>", "<|endoftext|>", "'ll", "'ve"]
    ids = lambda t: np.frombuffer(coder.encode(t), dtype=coder.type).tolist()
    for long in (packing._LONG.pattern, packing._WHITE + "{3,}"):
        monkeypatch.setattr(packing, "_LONG", re.compile(long))
        for _ in range(50_000):
            t = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 14)))
            assert ids(t) == lib.encode(t, add_special_tokens=False).ids, repr(t)
    monkeypatch.undo()
    for t in (" " * 40_000 + "x", "x" + "  " * 9000, "\u3000 " * 4000 + "<|endoftext|>  "):
        assert ids(t) == lib.encode(t, add_special_tokens=False).ids
    assert len(ids("  " * 600_000 + "x")) == 1_200_000


def test_hilbert_is_a_curve():
    side = 8
    points = np.array([(a, b, c, d) for a in range(side) for b in range(side) for c in range(side) for d in range(side)])
    order = points[np.argsort(packing.hilbert(points, bits=3))]
    assert len(set(packing.hilbert(points, bits=3).tolist())) == side**4 and (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


# toxicity


def test_toxicity_learns_and_ignores_groups(spark):
    rng = random.Random(8)
    words = ["river", "stone", "house", "table", "green", "walks", "women", "muslims"]
    texts, toxic = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = [rng.choice(words[:6]) for _ in range(30)]
        if bad:
            w[rng.randrange(30)] = rng.choice(["idiotic", "scumbag"])
        if rng.random() < (0.8 if bad else 0.1):
            w[rng.randrange(30)] = rng.choice(words[6:])
        texts.append(" ".join(w) + ".")
        toxic.append(int(bad))
    docs = documents(spark, texts, extra=True)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(None, 1, 1), (0, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, toxicity.Options())
    score = toxicity.Scorer(model)
    assert score("the women and muslims walks green") < 0.3 < score("you scumbag") and 0 <= score("") <= 1 and score(None) == score("")
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model).collect()}
    assert sum((got[i] >= 0.3) == t for i, t in enumerate(toxic)) >= 396
    assert toxicity.filtered(docs, model, 0.3).columns == docs.columns
    for some in (labels.limit(0), labels.filter("toxic = 1")):
        flat = toxicity.fit(docs, some)
        assert toxicity.Scorer(flat)("scumbag") == toxicity.Scorer(flat)("") and 0 < toxicity.Scorer(flat)("") <= 1
    assert toxicity.swapped("Women walk. Stones fall.") == "men walk. stones fall." and toxicity.swapped("nothing here") is None


def test_counterfactual_penalty_acts(spark):
    """Labels follow group names in part: without the penalty neutral mentions are called toxic, with it they aren't."""
    rng = random.Random(4)
    words, groups = ["river", "stone", "house", "table", "green", "walks", "and", "near"], ["women", "muslims", "immigrants", "jewish"]
    texts, toxic = [], []
    for i in range(1200):
        bad = i % 4 == 0
        w = [rng.choice(words) for _ in range(20)]
        if bad and rng.random() < 0.7:
            w[3] = rng.choice(["idiotic", "scumbag"])
        if rng.random() < (0.9 if bad else 0.05):
            w[9] = rng.choice(groups)
        texts.append(" ".join(w) + ".")
        toxic.append(int(bad))
    docs = documents(spark, texts)
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    plain, fair = (toxicity.Scorer(toxicity.fit(docs, labels, toxicity.Options(swap_weight=w))) for w in (0.0, 1.0))

    def change(score):
        return np.mean([abs(score(t) - score(c)) for t in texts for c in toxicity.counterfactuals(t)])

    assert change(plain) > 0.2 and change(fair) < 0.05 * change(plain)
    neutral = [f"the {g} walks near green river {w}" for g in groups for w in words]
    assert sum(plain(t) >= 0.3 for t in neutral) > 0.9 * len(neutral) and sum(fair(t) >= 0.3 for t in neutral) < 0.1 * len(neutral)
    slurs = [f"the {w} scumbag walks near {x}" for w in words for x in words]
    assert sum(fair(t) >= 0.3 for t in slurs) > 0.95 * len(slurs)


# URLs


def brute_judge(url, rules, default):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.split(c)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: (len(r.text), r.host.count(".")), default=None)
    return host, path, best.text if best else None, best.verdict if best else default


@pytest.mark.parametrize("bits", [None, 1.0])
def test_url_verdicts(spark, bits):
    rng = random.Random(9)
    hosts = ["Example.org", "a.example.org", "notexample.org", "x.com", "com", "org", "a..org", "é.ORG", ""]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/es/', '/en/1', '/en/12?x', '/fr/#a', '/de/x/y', '?q', '#f', '/es'])}" for _ in range(400)] + [None, "", "no scheme", "a://b://c/d", "://"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' AS host", "1 AS word")
    rules = urlfilter.RULES + [urlfilter.Rule("x.com", "", "block")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages, rules, default="block", bits_per_key=bits).collect()}
    want = {i: brute_judge(u, rules, "block") for i, u in enumerate(urls)}
    assert got == want
    many = rules + [urlfilter.Rule(f"h{i}.{'x.' * (i % 7)}net", "/" + "p" * (i % 40), ("allow", "block", "review")[i % 3]) for i in range(600)]
    more = spark.createDataFrame([(i, f"http://s.{r.host}{r.path}q") for i, r in enumerate(many)], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge(more, many, bits_per_key=bits).collect()}
    assert got == {i: brute_judge(f"http://s.{r.host}{r.path}q", many, "allow")[2:] for i, r in enumerate(many)}
    clash = urlfilter.judge(pages.selectExpr("*", "1 AS _host", "2 AS _best", "'y' AS Rule", "'z' AS host_"), rules)
    assert clash.columns == ["page_id", "url", "host__", "word", "_host", "_best", "Rule_", "host_", "host", "path", "rule", "verdict"] and clash.filter("host__ <> 'x' OR _host <> 1 OR Rule_ <> 'y'").count() == 0
    assert {r["verdict"] for r in urlfilter.judge(pages, []).collect()} == {"allow"}
    assert urlfilter.judge(pages.limit(0), rules).count() == 0
    with pytest.raises(ValueError):
        urlfilter.judge(pages, [rules[0], urlfilter.Rule("org", "/", "block")])


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(3000).selectExpr("concat('k', id) AS key")
    listed = spark.range(0, 3000, 7).selectExpr("concat('k', id) AS key")
    cascade = urlfilter.build_cascade(listed, universe, bits_per_key=2.0)
    assert len(cascade.levels) > 2
    assert universe.select("key", cascade.listed(universe["key"]).alias("yes")).filter("yes <> (cast(substring(key, 2) as int) % 7 = 0)").count() == 0


# WARC


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 700
    rows = [(1, "http://a/\r\nX: y%", big), (2, None, big), (5, "http://b", big), (3, "http://c", None), (4, "http://d", ""), (None, "http://e", big), (6, "http://f", "WARC/1.0\r\n\r\n"), (7, "http://g", "z" * 999), (8, "http://h", "z" * 999), (9, "http://i", "q" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = f"file://{tmp_path}/out"
    warc.archive(pages, "page_id", "url", "html", path)
    df = spark.read.format("warc").load(path)
    got = {r["record_id"]: r for r in df.collect()}
    assert len(got) == len(rows)
    for i, url, html in rows:
        r, body = got[f"urn:page:{'none' if i is None else i}"], (html or "").encode()
        assert (r["target_uri"], r["payload_bytes"], r["payload_digest"]) == (url, len(body), hashlib.sha1(body).hexdigest())
        again = i in (1, 2)
        assert (r["record_type"], r["refers_to"]) == (("revisit", "urn:page:5") if again else ("response", None))
        assert r["payload"] == (None if again else body)
    only = df.filter("record_type = 'revisit' and target_uri like 'http://a%'")
    assert [r["record_id"] for r in only.collect()] == ["urn:page:1"]
    heads = spark.read.format("warc").option("payload", "false").load(path)
    assert heads.filter("payload is not null").count() == 0 and heads.count() == len(rows)
    assert warc.WarcReader({"path": path, "partition_bytes": "1"}).partitions() and len(warc.WarcReader({"path": path}).partitions()) == 1
    warc.archive(pages.limit(0), "page_id", "url", "html", f"file://{tmp_path}/none")
    assert spark.read.format("warc").load(f"file://{tmp_path}/none").count() == 0


def test_row_keys(spark):
    docs = spark.createDataFrame([(None, "b"), (2, "x"), (2, "a"), (2, "a"), (1, None)], "doc_id long, text string")
    got = sorted((r["_key"], r["doc_id"] or -1, r["text"]) for r in with_key(docs).collect())
    assert [d for _, d, _ in got] == [-1, 1, 2, 2, 2] and len({k for k, *_ in got}) == 4
    assert [r["_key"] for r in with_key(docs.filter("doc_id = 1")).collect()] == [1]
