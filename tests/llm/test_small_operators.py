"""Chat formatting, URL filters, token counts, language ID, quality rules against plain Python."""
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from segscope.llm import chat_format, lang_id, quality_rules, token_counts, url_filter
from segscope.llm.queries import SITE_RULES, tokenizer_path

WORD = r"[^\x20\x09-\x0D]+"


def test_chat_ties_follow_the_raw_texts(spark):
    """Escaping would put '<|x' before '0'; rows of one turn stand in the order of their own role and text."""
    rows = [(1, 0, "user", "<|x"), (1, 0, "user", "0"), (1, 0, "user", "&"), (1, 0, "[INST]", "z"), (1, 0, "Z", "a"), (1, 0, "a\nb", "<s>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    out = chat_format.format_conversations(df).select(chat_format.read_turns(F.col("formatted")).alias("t")).first()["t"]
    assert [(t["role"], t["text"]) for t in out] == sorted((r, t) for _, _, r, t in rows)


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a & b <|im_end|>\n <|im_start|>x"), (1, 1, "assistant", "</s>[INST]&lt;|"), (1, 2, "assistant", None),
            (1, 2, "assistant", "tie"), (1, 2, "assistant", "tie"), (2, None, None, None), (2, 5, "a\nb", "x<|im_sep|>"),
            (None, 1, "user", ""), (3, 1, "assistant", "&#91;INST] <")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows],
                               "conv_id long, turn long, role string, text string, formatted string, segments int")
    out = chat_format.format_conversations(df)
    got = {r["conv_id"]: r for r in out.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"),
                                               chat_format.loss_text(F.col("segments")).alias("loss")).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(([r for r in rows if r[0] == conv]), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == [(r[2] or "", r[3] or "") for r in turns]
        assert got[conv]["loss"] == "".join(r[3] or "" for r in turns if r[2] == "assistant")
    assert got[1]["formatted"].count(chat_format.START) == 2  # adjacent assistant rows are one turn
    assert chat_format.format_conversations(df.limit(0)).collect() == []


def test_url_rules(spark):
    urls = ["https://a.example.net/en/1?x#y", "http://EXAMPLE.net/de/", "https://example.com/de/1", "https://example.com/fr/ads/1",
            "https://net", "https://net/", "ftp://x.org/fr/?q", "https://org/fr", None, "no scheme", "", "https://a.b/track/z.gif",
            "https://badexample.net/en/", "x://y?://z/", "https://example.net/en/", "https://example.net/en/"]
    rules = SITE_RULES + [url_filter.Rule("block", "/ads/"), url_filter.Rule("block", "/track/*.gif"), url_filter.Rule("block", "zz")]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(df, rules).collect()}
    assert len(got) == len(urls)

    def judged(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m and "://" in url else ("", "")
        fits = []
        for r in SITE_RULES:
            h, p = r.name.split("/", 1)
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
                fits.append(r)
        best = max(fits, key=lambda r: len(r.name), default=None)
        bad = any(re.search(x, host + path) for x in ("/ads/", "/track/.*[.]gif", "zz"))
        return host, path, best and best.name, best.verdict if best else "block" if bad else "allow"

    for i, u in enumerate(urls):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == judged(u), u
    assert url_filter.filter_urls(df.limit(0), rules).collect() == []


def test_token_counts_equal_word_by_word(spark):
    pieces = token_counts.piece_list(tokenizer_path("piece_bpe_32k.model"))
    scores, longest = token_counts.scores_of(pieces), max(map(len, pieces))

    def tokens(word):
        word, best = token_counts.MARK + word, [(0.0, 0)]
        for end in range(1, len(word) + 1):
            options = [(best[end - 1][0] + token_counts.UNKNOWN, best[end - 1][1] + 1)]
            options += [(best[end - n][0] + scores[word[end - n:end]], best[end - n][1] + 1)
                        for n in range(1, min(end, longest) + 1) if word[end - n:end] in scores]
            top = max(o[0] for o in options)
            best.append((top, min(o[1] for o in options if o[0] > top - 1e-9)))
        return best[-1][1]

    texts = ["Hello world, hello worlds", None, "", " \n", "日本語 🎉 naïve", "x" * 200 + " tail", "Hello world, hello worlds"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in token_counts.token_counts(df, tokenizer_path("piece_bpe_32k.model")).collect()}
    assert got == {i: (len((t or "").split()), sum(tokens(w) for w in (t or "").split())) for i, t in enumerate(texts)}
    assert token_counts.token_counts(df.limit(0), tokenizer_path("piece_bpe_32k.model")).collect() == []


def test_language_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = lang_id.learn(docs)
    got = lang_id.predict_languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 !!", "x"), (4, "the of and the of", "x"), (4, "the of and the of", "x")],
                                "doc_id long, text string, rejected string")
    rows = lang_id.predict_languages(odd, model).collect()
    assert [r["lang_pred"] for r in rows][:3] == ["und"] * 3 and all(r["score"] == 0 and r["rejected"] for r in rows[:3])
    assert rows[3] == rows[4] and 0 <= rows[3]["score"] <= 1
    assert lang_id.keep_known(odd, model).columns == odd.columns
    assert lang_id.learn(docs.limit(0)) == {} and lang_id.predict_languages(odd, {}).where("lang_pred <> 'und'").isEmpty()


def plain_quality(text):
    t = text or ""
    w = re.findall(WORD, t)
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    windows = Counter(zip(w, w[1:], w[2:]))
    repeat = {j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeat),
            n < 50 or 100 * len(repeat) > 50 * n)


@pytest.mark.parametrize("kind", ["small", "table"])
def test_quality_counts(spark, kind):
    if kind == "small":
        texts = [None, "", " \n\t", "a b", "a b c", "a b c a b c", "a b c\na b c\n\na b c", "é# $$ <|>\n\x0b \x0b\n", "x " * 400,
                 "p q r s t p q r u v q r s", "a\x1cb c", "a b c\na b c"]
        df = spark.createDataFrame([(i, t, "clash", 7) for i, t in enumerate(texts)], "doc_id long, text string, score string, _w int")
        labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1)], "doc_id long, quality int")
    else:
        df, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in quality_rules.quality_table(df, labels).collect()}
    for r in df.collect():
        g = got[r["doc_id"]]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"], g["base_failed"]) == plain_quality(r["text"])
    kept = quality_rules.judge(df, labels)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}
    assert quality_rules.quality_table(df.limit(0), labels).collect() == []


def test_quality_score(spark):
    """Weights and scores against a direct count, and junk against prose."""
    df, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.with_buckets(df.select("doc_id", "text")).select("doc_id", "_b").collect()
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    raw, target = Counter(), Counter()
    for r in rows:
        raw.update(r["_b"])
        if r["doc_id"] in good:
            target.update(r["_b"])
    weights = quality_rules.fit(quality_rules.with_buckets(df.select("doc_id", "text")), labels)
    import math
    n, m, size = sum(raw.values()), sum(target.values()), quality_rules.BUCKETS
    for b in list(raw)[:200]:
        assert weights[b] == pytest.approx(math.log((target[b] + 1) / (m + size)) - math.log((raw[b] + 1) / (n + size)))
    got = {r["doc_id"]: r for r in quality_rules.quality_table(df, labels).collect()}
    for r in rows[:100]:
        if r["_b"]:
            assert got[r["doc_id"]]["score"] == pytest.approx(sum(weights[b] for b in r["_b"]) / len(r["_b"]), abs=1e-5)
    marked = [(r["quality"], got[r["doc_id"]]) for r in labels.collect()]
    assert all(g["kept"] for q, g in marked if q == 1 and not g["base_failed"])
    assert not any(g["kept"] for q, g in marked if q == 0)


def _viterbi(scores, word):
    best = [(0.0, 0)]
    longest = max(map(len, scores))
    for end in range(1, len(word) + 1):
        s, t = best[end - 1][0] + token_counts.UNKNOWN, best[end - 1][1] + 1
        for n in range(1, min(end, longest) + 1):
            if (p := scores.get(word[end - n:end])) is not None:
                s2, t2 = best[end - n][0] + p, best[end - n][1] + 1
                if s2 > s + 1e-9 or (s2 > s - 1e-9 and t2 <= t):
                    s, t = s2, t2
        best.append((s, t))
    return best[-1][1]


def test_token_counts_of_a_whole_table(spark):
    model = tokenizer_path("piece_bpe_32k.model")
    scores, known = token_counts.scores_of(token_counts.piece_list(model)), {}
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in token_counts.token_counts(df, model).collect()}
    for r in df.collect():
        w = (r["text"] or "").split()
        for x in set(w).difference(known):
            known[x] = _viterbi(scores, token_counts.MARK + x)
        assert got[r["doc_id"]] == (len(w), sum(map(known.__getitem__, w)))


def test_long_words_are_cut_where_no_piece_spans():
    import random
    scores = token_counts.scores_of(token_counts.piece_list(tokenizer_path("piece_bpe_32k.model")))
    counter, rnd = token_counts.Counter(scores), random.Random(6)
    words = ["".join(rnd.choices("日本語学中文的了是不", k=300)), "the" * 50 + "日本" * 40, "ab" * 200, "".join(rnd.choices("abcdefgh", k=150)) + "é😀" * 30]
    counter.learn(set(words))
    assert [counter.seen[w] for w in words] == [_viterbi(scores, token_counts.MARK + w) for w in words]
    assert max(map(len, counter.cut(words[0]))) <= token_counts.LONG_WORD
    long = "".join(rnd.choices([chr(c) for c in range(0x4e00, 0x9000)], k=200_000))
    counter.learn({long})
    assert counter.seen[long] >= 200_000 and all(len(p) < 100 for p in counter.cut(long))


def test_language_by_plain_compression(spark):
    """Each language's dictionary, one compressor at a time, over a whole table."""
    import zstandard as z
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = lang_id.learn(df)
    got = {r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in lang_id.predict_languages(df, model).collect()}
    params = z.ZstdCompressionParameters(strategy=z.STRATEGY_GREEDY, min_match=4, search_log=4, window_log=17, hash_log=16, chain_log=16)
    by = {k: z.ZstdCompressor(dict_data=z.ZstdCompressionDict(v, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=params) for k, v in model.items()}
    for r in df.collect():
        words, parts = re.findall(r"[^\W\d_]{1,48}", (r["text"] or "").lower()), []
        for at in range(0, len(words), 400):
            seen = []
            for w in words[at:at + 400]:
                if w not in seen:
                    seen.append(w)
            parts.append(" ".join(seen).encode() + b"\0" * 64)
        if not parts:
            assert got[r["doc_id"]] == ("und", True)
            continue
        size = {k: sum(len(c.compress(p)) for p in parts) for k, c in by.items()}
        first, second = sorted(size.values())[:2]
        assert got[r["doc_id"]] == (min(size, key=lambda k: (size[k], k)), (second - first) / second < lang_id.NARROW)


def test_language_of_texts_without_spaces_and_ties():
    text = "".join(chr(0x4e00 + i * i % 20000) for i in range(200_000))
    parts = lang_id.chunks(text)
    assert max(map(len, parts)) < 1 << 17 and sum(p.count(b" ") + 1 for p in parts) <= -(-200_000 // 48)
    model = (("aa", b"some words of one language"), ("bb", b"some words of one language"))
    assert lang_id.classify("other words", model)[0] == "aa" and lang_id.classify("other words", model)[3]


def test_repeated_ids_give_one_passage_each(spark):
    rows = [(1, f"text number {i} of many", "en") for i in range(300)] + [(5, "ein deutscher text", "de")]
    model = lang_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model) <= {"en", "de"} and len(model.get("en", b"")) < 40


def test_a_rare_class_is_kept_whole(spark):
    from segscope.llm import toxicity
    ids = list(range(20_000))
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 400 == 1)) for i in ids], "doc_id long, toxic int")
    got = toxicity.labelled(docs, labels, 1000).groupBy("toxic").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()
    n = {r["toxic"]: (r["n"], r["w"]) for r in got}
    toxic = labels.where("toxic = 1").where(~toxicity.held_out(F.col("doc_id"))).count()
    assert n[1] == (toxic, toxic) and 700 < n[0][0] < 1200 and abs(n[0][1] / 15_000 - 1) < 0.15
