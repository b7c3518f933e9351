"""Operators 1, 2, 4, 5, 7, 8: against libraries and brute force, and their defined cases."""

import io
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from plumbline.llm import decontaminate, html_extract, license_scan, quality, sentencepiece_lattice, token_files
from plumbline.llm.shingles import WordHashes, shingle_set, split_words

PIECES, WORDS = P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")
ODD = ["Hello  world\n\nfoo", "  lead", "trail  ", "é中😀\x00x\t", "a▁b", "", "   ", "ﬁ Å é́x", "a" * 300, "supercali" * 9, "the of and " * 400, None]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def docs(spark, texts, extra=False):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "1 AS key", "2 AS node", "3 AS TEXT_2") if extra else df


# 1 --------------------------------------------------------------------------------------------------------------------


def test_sentencepiece_equals_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    df = docs(spark, ODD + ODD, extra=True).union(docs(spark, ["x y"], True).selectExpr("CAST(NULL AS LONG)", "text", "key", "node", "TEXT_2"))
    got = {r["doc_id"]: r for r in sentencepiece_lattice.encode(df, PIECES).collect()}
    assert len(got) == 25
    for i, t in enumerate(ODD + ODD):
        assert list(got[i]["ids"]) == lib.encode(t or "") and got[i]["n_tokens"] == len(got[i]["ids"])
        assert got[i]["round_trip"] == ("▁" not in (t or ""))
    back = dict(sentencepiece_lattice.decode(sentencepiece_lattice.encode(df.where("doc_id < 4"), PIECES), PIECES).collect())
    assert back == {i: ODD[i] for i in range(4)}
    assert sentencepiece_lattice.encode(df.limit(0), PIECES).count() == 0


def test_sentencepiece_in_small_chunks(spark, monkeypatch):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    monkeypatch.setattr(sentencepiece_lattice, "CHUNK", 50)
    texts = [f"text number {i} of the lot." for i in range(12)] * 2 + ["", None]
    got = {r["doc_id"]: list(r["ids"]) for r in sentencepiece_lattice.encode(docs(spark, texts).coalesce(1), PIECES).collect()}
    assert got == {i: lib.encode(t or "") for i, t in enumerate(texts)}


def test_viterbi_fold_of_a_unigram_model(spark, tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto.FromString(open(PIECES, "rb").read())
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    for i, p in enumerate(proto.pieces):
        p.score = -0.5 * len(p.piece) ** 0.9 - i * 1e-5 if p.type == 1 else 0.0
    (tmp_path / "m.model").write_bytes(proto.SerializeToString())
    lib = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "m.model"))
    texts = ["the international workers", "xyzzy plugh 中文", "a b"]
    got = dict((r["doc_id"], list(r["ids"])) for r in sentencepiece_lattice.encode(docs(spark, texts), str(tmp_path / "m.model")).collect())
    assert got == {i: lib.encode(t) for i, t in enumerate(texts)}


# 2 --------------------------------------------------------------------------------------------------------------------


def page(body):
    return f"<html><head><title>T</title><script>var a='</p>';</script></head><body>{body}</body></html>"


def test_html_main_text(spark):
    article = "<nav><ul><li>menu</li></ul></nav><div class='ad'>buy</div><article><h1>A &amp; B</h1><p><b>one\n two<br><p>three <i>f</i>our</p><div id='comments'>me too</div><form>f</form></article><footer>f</footer>"
    plain = lambda x: f"<div class='sidebar'>s</div><div>Site slogan</div><div>{x} text</div><div>Imprint</div>"
    given = [
        (1, "http://h/a/1", page(article)), (2, "http://h/b/1", page(plain("first"))), (3, "http://h/b/2", page(plain("second"))), (4, "http://h/b/3", page(plain("third"))),
        (5, "http://other/x", page(plain("lone"))), (6, "u", None), (7, None, ""), (8, "http://h/a/9", "<article><p>cut off <div cla"), (1, "http://h/a/1", page(article)), (None, None, page(plain("no id"))),
    ]
    got = html_extract.extract(spark.createDataFrame(given, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS path"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    text = {}
    for r in got.collect():
        text.setdefault(r["page_id"], []).append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert text[1] == ["A & B\none two\nthree four"] * 2
    assert [text[i] for i in (2, 3, 4)] == [["first text"], ["second text"], ["third text"]]
    assert text[5] == ["Site slogan\nlone text\nImprint"] and text[6] == text[7] == [""] and text[8] == ["cut off"]
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_copies_are_no_evidence_of_furniture(spark):
    long = lambda x: "".join(f"<p>{x} paragraph {i}, of some length and with words of its own</p>" for i in range(6))
    site = lambda x: page(f"<div>Site slogan</div>{x}<div>Imprint</div>")
    own = lambda x: "\n".join(f"{x} paragraph {i}, of some length and with words of its own" for i in range(6))
    copies = [(i, f"http://h/a/b?x={i}", site(long("copied"))) for i in range(10, 90)] + [(90, "http://h/a/b?x=5print", page(long("copied")))]
    given = [*copies, (1, "http://h/c/1", site(long("one"))), (2, "http://h/0/2", site(long("two"))), (3, "http://twins/x?1", site(long("twin"))), (4, "http://twins/x?2", site(long("twin")))]
    df = spark.createDataFrame(given, "page_id long, url string, html string")
    for parts in ("4", "23"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            text = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert len(text) == len(given) and all(text[i] == own("copied") for i in range(10, 91))
        assert text[1] == own("one") and text[2] == own("two")
        assert text[3] == text[4] == "Site slogan\n" + own("twin") + "\nImprint"


def test_pages_that_only_name_an_article_are_differenced(spark):
    odd = ["<article></article>", "<!-- <article> -->", "<script>var x = '<main >'</script>", "<article hidden>no</article>"]
    given = [(i, f"http://h/{i}", page(f"<div>Site slogan</div>{x}<div>text number {i}</div><div>Imprint</div>")) for i, x in enumerate(odd)]
    got = html_extract.extract(spark.createDataFrame(given, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: f"text number {i}" for i in range(len(odd))}


def test_names_inside_an_article():
    kept = ["<header class='entry-header'><h1>t</h1></header>", "<div class='article-header'>t</div>", "<section id='related-work'>t</section>", "<p class='social-history'>t</p>", "<h2 class='header'>t</h2>", "<p class='price share-price'>t</p>", "<div class='header'>t</div>"]
    gone = ["<div class='related'>t</div>", "<div id='comments'>t</div>", "<div class='x share-buttons'>t</div>", "<div class='related-posts'>t</div>", "<div class='siteHeader'>t</div>", "<ul class='social-links'><li>t</ul>", "<div class='ad-container'><h2>t</h2></div>"]
    doubtful = ["<section id='related-work'>t</section>", "<p class='social-history'>t</p>", "<p class='price share-price'>t</p>", "<div class='related-findings'>t</div>", "<div class='notice-period'>t</div>", "<table id='comment-table'><tr><td>t</table>"]
    kept = [x for x in kept if x not in doubtful]
    for tag in ("article", "main"):
        assert [html_extract.blocks(f"<{tag}>{x}</{tag}>") for x in kept] == [[("t", html_extract.IN)]] * len(kept)
        assert [html_extract.blocks(f"<{tag}>{x}</{tag}>") for x in doubtful] == [[("t", html_extract.DOUBTFUL)]] * len(doubtful)
        assert [html_extract.blocks(f"<{tag}>{x}</{tag}>") for x in gone] == [[]] * len(gone)
    assert html_extract.blocks("<div class='related-work'>t</div>") == []  # no article: as before


def test_shared_lines_inside_articles(spark):
    """Lines in an article stay, shared or not; doubtful ones stay unless the neighbour has them; open ones are no text."""
    body = lambda x, note: page(f"<div>Site slogan</div><article><p>shared sentence</p><p>{x} text of its own</p><div class='notice-period'>{note}</div></article><p>after</p>")
    given = [(2**53 + 1, "http://h/a/1", body("first", "same note")), (2**53 + 3, "http://h/a/2", body("second", "same note")), (3, "http://h/a/3", body("third", "three months")), (None, "http://g/1", body("lone", "same note"))]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(given, "page_id long, url string, html string")).collect()}
    assert got == {
        2**53 + 1: "shared sentence\nfirst text of its own", 2**53 + 3: "shared sentence\nsecond text of its own",
        3: "shared sentence\nthird text of its own\nthree months", None: "shared sentence\nlone text of its own\nsame note",
    }


def test_differencing_equals_brute_force(spark):
    """Unlike pages of some hosts, sorted in plain Python and compared with both neighbours."""
    import os.path
    import random

    rng = random.Random(2)
    given = []
    for i in range(120):
        host, path = rng.choice(["a", "b", "c"]), "/".join(rng.choice("xyz") for _ in range(rng.randint(1, 3))) + f"/{i:03}"
        lines = [f"menu {rng.randint(0, 3)}", f"own line {i} of page {i} that is far longer than any menu line here", f"menu {rng.randint(0, 3)}", f"second line {i} of page {i} that is long as well"]
        kind = rng.choice(["div", "article"])
        given.append((i, f"http://{host}/{path}", f"<{kind}>" + "".join(f"<p{' class=share-price' if kind == 'article' and x.startswith('menu') else ''}>{x}</p>" for x in lines) + f"</{kind}>", lines))
    order = sorted(given, key=lambda r: (r[1].split("/")[2], r[1].split("/", 3)[3]))
    want = {}
    for k, (i, url, _, lines) in enumerate(order):
        sides = [order[j] for j in (k - 1, k + 1) if 0 <= j < len(order) and order[j][1].split("/")[2] == url.split("/")[2]]
        near = max(sides, key=lambda r: len(os.path.commonprefix([r[1], url])))  # the first of equals is the one before
        gone = html_extract.common_lines(lines, near[3])
        want[i] = "\n".join(x for n, x in enumerate(lines) if n not in gone)
    df = spark.createDataFrame([r[:3] for r in given], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_extract.extract(df.repartition(5)).collect()} == want


def test_longest_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = rng.integers(0, 5, 9).tolist(), rng.integers(0, 5, 7).tolist()
        table = np.zeros((10, 8), int)
        for i in range(9):
            for j in range(7):
                table[i + 1, j + 1] = max(table[i, j + 1], table[i + 1, j], table[i, j] + (a[i] == b[j]))
        kept = sorted(html_extract.common_lines(a, b))
        assert len(kept) == table[9, 7]
        at = -1
        for i in kept:
            at = b.index(a[i], at + 1)


# 4 --------------------------------------------------------------------------------------------------------------------


def test_decontamination_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    word = lambda n: " ".join(rng.choice([f"w{i}" for i in range(3000)], n))
    items = [word(n) for n in (2, 4, 5, 8, 30, 90, 700)] + ["", None, "W1 w2"]
    texts = [word(5000) for _ in range(4)] + ["", None, "w1  W2"]
    for i, t in enumerate(items[:7]):
        part = t.split()
        texts += [word(900) + "\n" + t.upper() + "\t" + word(900), " ".join(part[: len(part) * 9 // 10 + 1]), " ".join(part[: len(part) // 2])]
    d, b = docs(spark, texts, True), spark.createDataFrame(list(enumerate(items)) + [(3, items[3])], "item_id long, text string")

    def brute(items):
        out = []
        for i, t in enumerate(items):
            w = split_words(t)
            s = {tuple(w[k : k + min(5, len(w))]) for k in range(max(1, len(w) - 4))} if w else set()
            for j, x in enumerate(texts):
                y = split_words(x)
                n = min(5, len(w))
                got = {tuple(y[k : k + n]) for k in range(len(y) - n + 1)} if n else set()
                if s and 100 * len(s & got) >= 75 * len(s):
                    out.append((j, i, len(s & got), len(s)))
        return sorted(out)

    got = sorted(tuple(r)[:4] for r in decontaminate.find(d, b).collect())
    assert got == brute(items) and len(got) >= 10
    clean = {r["doc_id"] for r in decontaminate.clean(d, b).collect()}
    assert clean == set(range(len(texts))) - {g[0] for g in got}
    assert decontaminate.clean(d, b).columns == d.columns
    assert decontaminate.find(d.limit(0), b).count() == 0 and decontaminate.find(d, b.limit(0)).count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    d, b = docs(spark, ["a b c d e f g", "h i j k l m"]), spark.createDataFrame([(1, "a b c d e f"), (2, "h i j k l m"), (None, "a b c d e")], "item_id long, text string")
    whole = rows(decontaminate.find(d, b))
    monkeypatch.setattr(decontaminate, "BLOCK", 4)
    assert len(decontaminate.blocks(b)) > 1 and rows(decontaminate.find(d, b)) == whole and len(whole) == 3


# 5 --------------------------------------------------------------------------------------------------------------------


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORDS)
    texts = ["Straße ÄÖÜ don't 12 ###", "a<|endoftext|>b It's x́ É\x1cz\x85q ΣΑΣ", "", None, "x " * 40_000, "ß", "same", "same"]
    ids = [5, 3, 9, 1, 2, 3, 7, 7]
    df = spark.createDataFrame([*zip(ids, texts, strict=True), (None, "no id")], "doc_id long, text string").selectExpr("*", "1 AS start", "2 AS file")
    got = token_files.round_trip(df, WORDS, str(tmp_path)).orderBy("start").collect()
    order = sorted([*zip(ids, texts, strict=True), (None, "no id")], key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start = 0
    for r, (doc, text) in zip(got, order, strict=True):
        want = np.array(lib.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        assert tuple(r) == (doc, start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    assert token_files.round_trip(df.limit(0), WORDS, str(tmp_path / "e")).count() == 0


def test_rans_blocks_and_checksums():
    rng = np.random.default_rng(5)
    for n in (1, 31, 5000, token_files.BLOCK * 3 + 17):
        docs_ = [(7, rng.zipf(1.3, n).clip(max=49_000).astype(np.uint32)), (None, np.array([1], np.uint32))]
        raw = token_files.to_file(np.array([(d or 0, d is None, len(x)) for d, x in docs_], token_files._DOC), np.concatenate([x for _, x in docs_]))

        class File(io.BytesIO):
            def size(self, raw=raw):
                return len(raw)

        whole = np.concatenate([d for _, d in docs_])
        reader = token_files.Reader(File(raw))
        assert (np.concatenate(list(reader.ids())) == whole).all()
        last = len(reader.blocks) - 1  # any block on its own
        assert (np.concatenate(list(reader.ids(last, last + 1))) == whole[last * token_files.BLOCK :]).all()
    broken = bytearray(raw)
    broken[200] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        list(token_files.Reader(File(bytes(broken))).ids())


# 7 --------------------------------------------------------------------------------------------------------------------


def test_licences_equal_unpruned_dice(spark):
    lines = [*license_scan.TEMPLATES.values(), "Licensed under the Apache License", "licensed UNDER the apache license version 2 0 !", "MIT", "", "nothing here", "Released under the MIT License. And then some more."]
    texts = [*lines, "\n".join(lines[:3]), None, "x" * 200_000]

    def brute(text):
        out, t = [], {k: license_scan.bigrams(v.encode().lower()) for k, v in license_scan.TEMPLATES.items()}
        units = (text or "").split("\n")
        for i, u in [*enumerate(units, 1), *([(0, text)] if len(units) > 1 else [])]:
            s = license_scan.bigrams((u or "").encode().lower())
            best = max(((2 * len(s & b) / (len(s) + len(b)), k) for k, b in sorted(t.items()) if s), key=lambda x: x[0], default=(0, ""))
            if best[0] >= 0.8:
                out.append((i, best[1], best[0]))
        return out

    got = rows(license_scan.scan(docs(spark, texts, True)))
    assert got == sorted([(j, *hit) for j, t in enumerate(texts) for hit in brute(t)], key=str)
    assert license_scan.scan(docs(spark, texts).limit(0)).count() == 0


def test_licences_inside_longer_texts(spark):
    import textwrap

    prose = "\n".join(" ".join(f"w{8 * i + k}" for k in range(8)) for i in range(600))
    comment = lambda name: "\n".join(" * " + x for x in textwrap.wrap(license_scan.TEMPLATES[name], 70))
    names = ["MIT/text", "ISC/text", "Apache-2.0/header", "GPL-3.0/header", "MPL-2.0/notice", "BSD-2-Clause/text", "BSD-3-Clause/text", "LGPL-2.1/header", "LGPL-3.0/header", "AGPL-3.0/header", "GPL-2.0/header", "CC0-1.0/text", "Unlicense/text", "Apache-2.0/text", "MPL-2.0/text"]
    texts = [f"int main\n{comment(n)}\n\n{prose}" for n in names] + [
        prose.replace("\n", " ") + " Released under the MIT License. " + prose.replace("\n", " "),
        "alpha beta gamma delta released under\nthe MIT License and so on with more words of the text\n" + prose,
        "One line. All rights reserved.",
    ]
    found = {(r["doc_id"], r["line"], r["template"]) for r in license_scan.scan(docs(spark, texts)).collect()}
    assert found >= {(i, 2, n) for i, n in enumerate(names)}
    assert {f for f in found if f[0] >= len(names)} == {(len(names), 1, "MIT/notice"), (len(names) + 1, 1, "MIT/notice")}
    assert rows(license_scan.scan(docs(spark, ["All rights reserved."]))) == [(0, 1, "LicenseRef-all-rights-reserved/notice", 1.0)]


# 8 --------------------------------------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    s = quality.score(d, lab).join(lab, "doc_id").where("held_out").toPandas()
    assert (s["predicted"] == s["quality"]).mean() > 0.95
    pos, neg = s.loc[s["quality"] == 1, "score"].to_numpy(), s.loc[s["quality"] == 0, "score"].to_numpy()
    assert (pos[:, None] > neg[None]).mean() > 0.98
    kept = quality.keep_good(d, lab)
    assert kept.columns == d.columns and 700 < kept.count() < 1000


def test_quality_cases(spark):
    d = docs(spark, ["", None, "good text here", "good text here", "x " * 100_000], True).unionByName(docs(spark, ["z"], True).selectExpr("CAST(NULL AS LONG) AS doc_id", "text", "key", "node", "TEXT_2"))
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.score(d, none).collect()
    assert len(got) == 6 and all(r["score"] == 0.5 and r["predicted"] == 1 for r in got)
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    lab = spark.createDataFrame([(i, q) for i in range(5) for q in (0, 1, None)], "doc_id long, quality int")
    assert all(0 <= r["score"] <= 1 for r in quality.score(d, lab).collect())
    assert quality.score(d.limit(0), none).count() == 0
    x, y = quality.pool(np.arange(4.0), np.array([0, 1, 0.5, 1]), np.ones(4))
    assert y.tolist() == [0, 0.75, 1] and x.tolist() == [0, 1.5, 3]


def test_shingles():
    memo = WordHashes()
    assert len(shingle_set("a b c d", memo)) == 1 and len(shingle_set(" \n", memo)) == 0
    assert (shingle_set("A b\tc d e", memo) == shingle_set("a  b c d e", memo)).all()
    assert len(shingle_set("a b c d e a b c d e", memo)) == 5 and shingle_set("É x", memo) != shingle_set("é x", memo)
