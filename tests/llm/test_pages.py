import base64
import collections
import gzip
import hashlib
import json
import math
import random
import time
import zlib
from html.parser import HTMLParser

import pytest

from lumenfold.llm import html_text, warc
from lumenfold.llm.html_pages import Page
from lumenfold.llm.language import KneserNey, Model, held_out, identify, letter_table, symbols, train


def page_of(html: str) -> str:
    return html_text.extract([html], html_text.trained())[0]


def test_made_pages_not_seen_in_training():
    right = total = 0
    for i in range(120):
        p = Page(700_000_000 + i)
        got = page_of(p.html).split("\n\n")
        right += sum(any(g.startswith(k.strip()) for g in got) for k in p.kept)
        total += len(p.kept)
    assert right / total > 0.95


CASES = [
    ("", ""),
    ("<html><body></body></html>", ""),
    ("<nav><a href=/>Home</a></nav><article><h1>T &amp; U</h1><p>One\n  two<b> three</b>.<p>Four &eacute;&#8217;s words go on, and on, and on here.</article><footer>&copy; me</footer>", "T & U\n\nOne two three.\n\nFour é’s words go on, and on, and on here."),
    ("<article><p>A sentence that stays, as it should, here.</p><script>var x = '</p><p>no';</script><style>p{}</style><p>Another one, which stays as well.</p><div class='comments'><p>First comment by a reader.</p></div></article>", "A sentence that stays, as it should, here.\n\nAnother one, which stays as well."),
    ("<div class=cookie-banner>We use cookies to do things.</div><div class=content><p>The text of the article, whole and long enough to tell.</p><ul><li>point one of it<li>point two of it</ul></div>", "The text of the article, whole and long enough to tell.\n\npoint one of it\n\npoint two of it"),
]


@pytest.mark.parametrize("html, text", CASES)
def test_small_pages(html, text):
    assert page_of(html) == text


def test_letters_that_lower_case_lengthens_move_no_end():
    before = "\u0130stanbul " * 40 + "is where this sentence, long enough to stay, begins and ends."
    html = f"<article><p>{before}</p><SCRIPT>var x = '</p><p>no';</Script><p>Another one, which stays as well.</p><style>p{{}}</style><p>And the last one, which stays too.</p></article>"
    leaves = [x.text[0] for x in html_text.nodes_of(html_text.read_page(html)) if x.tag == "#text"]
    assert leaves == [before, "Another one, which stays as well.", "And the last one, which stays too."]


def test_dropped_nodes_drop_all_inside():
    nodes = html_text.nodes_of(html_text.read_page("<div><p>a a a</p><section><p>b b b</p><p>c c c</p></section></div>"))
    tags = [x.tag for x in nodes]
    logit = [5.0 if x.tag != "section" else -50.0 for x in nodes]
    import numpy as np

    assert html_text.decode(nodes, np.array(logit)) == ["a a a"] and "section" in tags


def test_pages_on_spark(spark):
    rows = [(1, "u", CASES[2][0], 5), (2, None, None, 5), (None, "v", "<p>", 5), (1, "u", CASES[2][0], 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract_text(df).collect()), key=repr)
    t = CASES[2][1]
    assert got == sorted([(1, t, len(t)), (1, t, len(t)), (2, "", 0), (None, "", 0)], key=repr)
    assert html_text.extract_text(df.filter("false")).count() == 0


def test_given_pages_keep_their_articles(spark, small):
    import re
    from html import unescape

    rows = html_text.extract_text(spark.read.parquet(f"{small}/pages.parquet")).collect()
    source = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in rows:
        body = source[r["page_id"]].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(unescape(re.sub(r"<[^>]+>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n\n".join(x for x in blocks if x)


# ---- archives


def test_derivatives_link_to_their_response(spark, tmp_path):
    html = "<title>A  b</title><nav><a href='/x?a=1&amp;b=2'>n</a></nav><p>Tëxt</p><img src=i.png>"
    df = spark.createDataFrame([(1, "http://a/", html, 3), (2, None, None, 3)], "page_id long, url string, html string, record_id int")
    made = warc.responses_of(df)
    rows = warc.build_derivatives(made, keep=("page_id",)).collect()
    assert sorted((r["page_id"], r["record_type"]) for r in rows) == [(1, "conversion"), (1, "metadata"), (2, "conversion"), (2, "metadata")]
    source = {r["page_id"]: next(warc.read_records(bytes(r["record"]))) for r in made.collect()}
    for r in rows:
        headers, block = next(warc.read_records(bytes(r["record"])))
        assert block == r["content"].encode() and warc.get(headers, "WARC-Refers-To") == r["refers_to"] == warc.get(source[r["page_id"]][0], "WARC-Record-ID")
        assert warc.get(headers, "WARC-Block-Digest") == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() and r["content_length"] == len(block)
        assert warc.get(headers, "WARC-Date") == warc.get(source[r["page_id"]][0], "WARC-Date")
    said = json.loads(next(r["content"] for r in rows if r["page_id"] == 1 and r["record_type"] == "metadata"))
    assert said["html"] == {"title": "A b", "links": [{"tag": "a", "at": "href", "url": "/x?a=1&b=2"}, {"tag": "img", "at": "src", "url": "i.png"}]}
    assert said["source"]["payload_digest"] == warc.digest(html.encode()) and said["http"]["status"] == "HTTP/1.1 200 OK"
    assert next(r["content"] for r in rows if r["page_id"] == 1 and r["record_type"] == "conversion") == "n\nTëxt"
    assert next(r["content"] for r in rows if r["page_id"] == 2 and r["record_type"] == "conversion") == ""
    out = str(tmp_path / "warc")
    warc.write_warc(warc.build_derivatives(made), out)
    again = warc.read_warc(spark, f"{out}/*.gz").collect()
    assert len(again) == 4 and {warc.get(next(warc.read_records(bytes(r["record"])))[0], "warc-record-id") for r in again} == {r["record_id"] for r in rows}
    assert warc.build_derivatives(made.filter("false")).count() == 0


def test_codings_and_other_records():
    body = "<p>ça va".encode("latin-1")
    packed = gzip.compress(body)
    chunked = b"%x\r\n" % 5 + packed[:5] + b"\r\n%x\r\n" % (len(packed) - 5) + packed[5:] + b"\r\n0\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked
    one = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<a>")], block)
    two = warc.record([("WARC-Type", "request")], b"GET / HTTP/1.1\r\n\r\n")
    found = [d for h, b in warc.read_records(one + two) for d in warc.derivatives(h, b)]
    assert [d["record_type"] for d in found] == ["metadata", "conversion"] and found[1]["content"] == "ça va"
    assert [d["content"] for h, b in warc.read_records(gzip.compress(one)[:]) for d in warc.derivatives(h, b)][1] == "ça va"
    broken = warc.record([("WARC-Type", "response")], b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\nnot gzip")
    assert [d["record_type"] for h, b in warc.read_records(broken) for d in warc.derivatives(h, b)] == ["metadata", "conversion"]


def test_malformed_pages_take_linear_time():
    n = 1 << 20
    for t in ("<a '", "<a b ", "<!", "<", "<a href='x ", '<a "x>', "</", "<title>", "<!--", "<p class='"):
        began = time.process_time()
        page = t * (n // len(t))
        html_text.read_page(page)
        warc.title_and_links(page)
        assert time.process_time() - began < 4, t
    leaves = [x.text[0] for x in html_text.nodes_of(html_text.read_page("<p>one</p><a href='x>two</a><p>three</p>")) if x.tag == "#text"]
    assert " ".join(leaves) == "one two three"


def test_inline_elements_of_articles_stay():
    page = "<article><p>The value of <math><mi>x</mi></math> is <button>seven</button> by <label>this table</label>, as said before.</p></article>"
    assert page_of(page) == "The value of x is seven by this table, as said before."


def plain_records(responses):
    """The derivatives of plain responses, worked out line by line."""
    out = []
    for head, status, fields, body in responses:
        source = dict(head)["WARC-Record-ID"]
        parser = Visible()
        parser.feed(body)
        parser.close()
        out.append((source, "metadata", dict(head)["WARC-Target-URI"], parser.title.strip(), [tuple(x) for x in parser.links]))
        out.append((source, "conversion", dict(head)["WARC-Target-URI"], "\n".join(x for x in (" ".join(b.split()) for b in parser.blocks) if x)))
    return out


class Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.links, self.title, self.skip, self.in_title = [""], [], "", 0, False

    def handle_starttag(self, tag, attributes):
        found = dict(attributes).get({"a": "href", "img": "src"}.get(tag))
        if found is not None:
            self.links.append((tag, found))
        self.in_title = tag == "title"
        self.skip += tag in ("script", "style", "title")
        if tag in ("p", "div", "h1", "ul", "li", "nav"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.in_title = False
        self.skip -= tag in ("script", "style", "title")
        if tag in ("p", "div", "h1", "ul", "li", "nav"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip:
            self.blocks[-1] += data


def test_derivatives_match_a_plain_reader():
    r = random.Random(8)
    word = lambda: r.choice(["é&amp;x", "wörd", "plain", "a &lt; b", "WARC/1.1", "x\r\ny"])
    pages = []
    for i in range(60):
        parts = [f"<title>{word()} {i}</title>", "<script>var a = '<a href=no>';</script>"]
        for _ in range(r.randrange(6)):
            parts.append(r.choice([f"<p>{word()} {word()}</p>", f"<div><h1>{word()}</h1><a href='/{i}?q=1&amp;r=2'>{word()}</a></div>", f"<ul><li>{word()}</li><li><b>{word()}</b></li></ul>", f'<nav><img src="{i}.png">{word()}</nav>', "<style>p{}</style><!-- <p>no</p> -->"]))
        pages.append("".join(parts))
    responses = [([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:{i}>"), ("WARC-Target-URI", f"http://h/{i}")], "HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8")], p) for i, p in enumerate(pages)]
    records = [warc.record(h, f"{s}\r\n{f[0][0]}: {f[0][1]}\r\n\r\n".encode() + b.encode()) for h, s, f, b in responses]
    got = []
    for headers, block in warc.read_records(b"".join(records[:30]) + b"" + b"".join(records[30:])):
        for d in warc.derivatives(headers, block):
            said = json.loads(d["content"]) if d["record_type"] == "metadata" else None
            got.append((d["refers_to"], d["record_type"], d["target_uri"], said["html"]["title"], [(x["tag"], x["url"]) for x in said["html"]["links"]]) if said else (d["refers_to"], d["record_type"], d["target_uri"], d["content"]))
    want = plain_records(responses)
    assert [(*w[:3], " ".join(w[3].split()), w[4]) if w[1] == "metadata" else w for w in want] == got


def test_cut_and_damaged_archives():
    records = [warc.record([("WARC-Type", "response"), ("WARC-Record-ID", f"<{i}>")], b"HTTP/1.1 200 OK\r\n\r\n<p>text %d" % i) for i in range(3)]
    members = [gzip.compress(x) for x in records]
    ids = lambda data: [warc.get(h, "warc-record-id") for h, _ in warc.read_records(data)]
    assert ids(b"".join(members)) == ["<0>", "<1>", "<2>"]
    assert ids(members[0] + members[1][:-9]) == ["<0>", "<1>"]  # cut short
    assert ids(members[0] + b"\x1f\x8b garbage") == ["<0>"] and ids(b"\x1f\x8b") == []
    body = b"HTTP/1.1 200 OK\r\n\r\n<p>quotes\r\nWARC/1.0 in its body"
    assert ids(warc.record([("WARC-Record-ID", "<q>")], body) + records[1]) == ["<q>", "<1>"]
    wrong = records[0].replace(b"Content-Length: ", b"Content-Length: 1")
    assert ids(wrong[:60] + wrong[60:] + records[1] + records[2])[0] == "<0>"


# ---- languages


def plain_kneser_ney(texts, symbols_of, vocabulary):
    """Interpolated Kneser-Ney with dictionaries: probability of a symbol after three others."""
    counts = {4: collections.Counter()}
    for t in texts:
        padded = [0, 0, 0, *symbols_of(t)]
        for i in range(3, len(padded)):
            counts[4][tuple(padded[i - 3 : i + 1])] += 1
    for k in (3, 2, 1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    discount = {}
    for k, c in counts.items():
        once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        discount[k] = once / (once + 2 * twice) if once else 0.5

    def p(context, s):
        k = len(context) + 1
        lower = 1 / vocabulary if k == 1 else p(context[1:], s)
        after = {g: n for g, n in counts[k].items() if g[:-1] == context}
        if not after:
            return lower
        total = sum(after.values())
        return max(after.get((*context, s), 0) - discount[k], 0) / total + discount[k] * len(after) / total * lower

    return p


def test_probabilities_match_dictionaries():
    import numpy as np

    table, r = letter_table("abcd"), random.Random(2)
    texts = ["".join(r.choice("aabcd  !") for _ in range(r.randrange(30))) for _ in range(25)]
    place = {c: int(table[ord(c)]) for c in "abcd"}

    def symbols_of(t):
        out = []
        for c in t:
            s = place.get(c, 0)
            if s or not out or out[-1]:
                out.append(s)
        return out

    grams, n = np.unique(symbols(texts, table)[0], return_counts=True)
    m, p = KneserNey(grams, n, 6), plain_kneser_ney(texts, symbols_of, 6)
    for _ in range(300):
        g = [r.choice([0, 1, *place.values()]) for _ in range(4)]
        code = sum(x << 16 * (3 - i) for i, x in enumerate(g))
        assert float(m.logp(np.array([code], np.uint64))[0]) == pytest.approx(math.log(p(tuple(g[:3]), g[3])), abs=1e-4)


def test_samples_are_ranked_in_buckets(spark, monkeypatch):
    import lumenfold.llm.language as language

    df = spark.createDataFrame([(i, f"t{i}", "xy"[i % 3 == 0] if i % 10 else None) for i in range(500)], "doc_id long, text string, lang string")
    whole = {(r["lang"], r["rank"], r["text"]) for r in language.sample_of(df, 1000, "doc_id", "text", "lang").collect()}
    few = {(r["lang"], r["rank"], r["text"]) for r in language.sample_of(df, 20, "doc_id", "text", "lang").collect()}
    assert few == {x for x in whole if x[1] <= 20} and len(few) == 40 and len(whole) == 450
    monkeypatch.setattr(language, "LANGUAGES", 1)
    assert few == {(r["lang"], r["rank"], r["text"]) for r in language.sample_of(df, 20, "doc_id", "text", "lang").collect()}



def test_probabilities_add_up():
    table = letter_table("abc")
    import numpy as np

    grams, n = np.unique(symbols(["abc abca bb", "cab!"], table)[0], return_counts=True)
    m = KneserNey(grams, n, 5)
    for context in (0, int(grams[3]) >> 16, (2 << 16) | 3):
        p = np.exp(m.logp(np.array([(context << 16) | s for s in range(5)], np.uint64)))
        assert abs(p.sum() - 1) < 1e-5 and (p > 0).all()


def test_texts_in_a_batch_stand_alone():
    m = Model("abc", {x: _counts(["abcabc abc", "cba"] if x == "l" else ["bbb aaa"]) for x in ("k", "l")})
    alone = [m.predict([t])[2][0] for t in ("abc a", "", "?!", "bbb", "xyz")]
    assert alone == pytest.approx(m.predict(["abc a", "", "?!", "bbb", "xyz"])[2])
    assert m.predict(["", "?!", "12", "ab"])[0][:3] == ["und"] * 3


def _counts(texts):
    import numpy as np

    return np.unique(symbols(texts, letter_table("abc"))[0], return_counts=True)


def test_held_out_accuracy_and_rejection(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = train(docs.filter(~held_out()))
    odd = spark.createDataFrame([(90001, None, "en"), (90002, "", None), (90003, "... 12", "en"), (None, "the", "en"), (90005, "Ωψχ ξζθ ωωω ξξξ " * 40, "en")], "doc_id long, text string, lang string").withColumn("score", held_out())
    got = {r["doc_id"]: r for r in identify(odd, model).collect()}
    assert [got[i]["lang_pred"] for i in (90001, 90002, 90003)] == ["und"] * 3 and not got[90001]["accepted"] and not got[90005]["accepted"]
    rows = identify(docs.filter(held_out()), model, keep=("lang",)).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97 and sum(not r["accepted"] for r in rows) <= 0.03 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows) and identify(docs.filter("false"), model).count() == 0
    none = train(docs.filter("false"))
    assert {r["lang_pred"] for r in identify(docs.limit(3), none).collect()} == {"und"}


def searched_records(data):
    """(headers, block) by one search after another over the whole bytes."""
    if data[:2] == b"\x1f\x8b":
        whole, rest = b"", data
        while rest[:2] == b"\x1f\x8b":
            member = zlib.decompressobj(31)
            for i in range(len(rest)):
                try:
                    whole += member.decompress(rest[i : i + 1])
                except zlib.error:
                    rest = b""
                    break
                if member.eof:
                    rest = member.unused_data + rest[i + 1 :]
                    break
            else:
                rest = b""
        data = whole
    at, out = data.find(b"WARC/"), []
    while at >= 0:
        ends = [(data.find(m, at), len(m)) for m in (b"\r\n\r\n", b"\n\n")]
        end, skip = next(((e, n) for e, n in ends if e >= 0), (len(data), 0))
        headers = warc.parse_headers(data[at:end].partition(b"\n")[2])
        n = warc.get(headers, "content-length")
        start = end + skip
        size = int(n) if n.isdigit() else 0
        out.append((headers, data[start : start + size]))
        at = start + size
        while data[at : at + 1] in (b"\r", b"\n") and at < len(data):
            at += 1
        if not data.startswith(b"WARC/", at):
            at = data.find(b"\nWARC/", at) + 1 or -1
    return out


@pytest.mark.parametrize("seed", range(12))
def test_streams_give_the_records_of_the_whole_bytes(seed, monkeypatch):
    monkeypatch.setattr(warc, "READ", 7)
    r = random.Random(seed)
    parts = []
    for i in range(12):
        block = bytes(r.choice(b"WARC/\r\n\n\x00\xffab") for _ in range(r.randrange(60)))
        made = warc.record([("WARC-Type", "response"), ("X", str(i))], block)
        if r.random() < 0.3:
            made = made.replace(b"Content-Length: ", r.choice([b"Content-Length: 9", b"Content-Length: x", b"content-length:"]))
        parts.append(made)
    data = b"".join(parts)[: -r.randrange(1, 40)]
    for whole in (data, b"".join(map(gzip.compress, parts)), gzip.compress(data)[:-5], gzip.compress(data) + b"rubbish", b"", b"\x1f", b"no record"):
        cuts = sorted(r.randrange(len(whole) + 1) for _ in range(20))
        pieces = [whole[a:b] for a, b in zip([0, *cuts], [*cuts, len(whole)], strict=True)]
        want = searched_records(whole)
        assert list(warc.records_in(pieces)) == want and list(warc.read_records(whole)) == want


def test_binary_blocks_survive_a_file(spark, tmp_path):
    blocks = [bytes(range(256)) * 3, b"", b"\xff\xfe\r\n\r\n", "é".encode()]
    rows = [(warc.record([("WARC-Type", "resource"), ("WARC-Record-ID", f"<{i}>")], b),) for i, b in enumerate(blocks)] + [(None,)]
    df = spark.createDataFrame(rows, "record binary").repartition(3)
    for kind in ("gzip", "none"):
        out = str(tmp_path / kind)
        warc.write_warc(df, out, compression=kind)
        again = warc.read_warc(spark, out).collect()
        found = {warc.get(h, "warc-record-id"): b for r in again for h, b in warc.read_records(bytes(r["record"]))}
        assert found == {f"<{i}>": b for i, b in enumerate(blocks)}
    members = sum(p.read_bytes().count(b"\x1f\x8b\x08") for p in (tmp_path / "gzip").glob("*.gz"))
    assert members >= 4 and not list((tmp_path / "gzip").glob("_*"))
    warc.write_warc(df.filter("record is null"), str(tmp_path / "none_at_all"))
    assert (tmp_path / "none_at_all").is_dir()
