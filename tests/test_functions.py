from __future__ import annotations

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from weblattice.functions import entities, fetching, hashing, html, onion, terms, words

#: Each piece is one way in which a page could run or load something; its mark must not come out.
RUNS = {
    "zap()": "<script>zap()</script>", "zip()": "<p onmouseover='zip()'>kept</p>", "sheet.css": "<link rel=stylesheet href=sheet.css>", "pic.gif": "<img src=pic.gif>", "back.gif": "<table background=back.gif><tr><td>cell</td></tr></table>",
    "inner": "<iframe src=inner></iframe>", "film": "<video src=film></video>", "tune": "<audio src=tune></audio>", "plug": "<object data=plug></object><embed src=plug>", "bg:url": "<span style='bg:url(x)'>s</span>",
    "hidden-note": "<!-- hidden-note -->", "submit-to": "<form action=submit-to></form>", "base64": "<a href='data:text/plain;base64,QQ=='>d</a>", "later()": "<a href=' JAVASCRIPT:later()'>j</a>", "shape": "<svg><circle id=shape /></svg>",
}


@pytest.mark.parametrize("mark", RUNS)
def test_html_keeps_nothing_that_runs_or_loads(mark):
    out = html.process(f"<body><p>before</p>{RUNS[mark]}<p>after</p></body>")
    assert mark.lower() not in out["html"].lower()
    assert out["text"].split("\n")[0] == "before" and out["text"].split("\n")[-1] == "after"


def test_html_text_title_and_links():
    p = html.process("<title>\n A  tidy\ttitle </title><ul><li>one <em>two</em></li><li>three</li></ul><a href='y?q=1'>go  <b>on</b></a><hr>end<a>no target</a>")
    assert p["title"] == "A tidy title"
    assert p["text"].split("\n")[:2] == ["one two", "three"]
    assert p["links"] == [{"url": "y?q=1", "anchor": "go on"}]


def test_html_base_charset_and_empty_input():
    assert html.process("<base href='http://abc.onion/x/'><a href='y'>y</a>")["base"] == "http://abc.onion/x/"
    assert html.process("<base href='http://evil.example/'>")["base"] is None
    assert html.decode(b"caf\xe9", "text/html; charset=iso-8859-1") == "café"
    assert html.decode("é".encode(), "text/html; charset=x-made-up") == "é"
    assert html.decode(b"<meta charset=windows-1251>\xcf", None).endswith("П")
    assert html.process(None)["text"] == html.process("")["text"] == ""
    assert html.decode(None, None) is None


@given(st.text(max_size=200))
@settings(max_examples=60, deadline=None)
def test_html_never_fails_and_leaves_no_script(s):
    p = html.process("<p>" + s + "<script>x</script>")
    assert "<script" not in p["html"].lower()


def test_addresses():
    a = onion.address_of(b"\x09" * 32)
    assert onion.is_address(a) and not onion.is_address(a[::-1]) and not onion.is_address(None) and not onion.is_address(a + "a")
    assert onion.addresses_in(f"HTTP://www.{a.upper()}.ONION/ {a}.onion abc.onion") == [a]
    base = f"http://{a}.onion/dir/page.html"
    for raw, want in {"../x/?b=2&a=1#frag": "/x/?a=1&b=2", "/p?utm_source=x&PHPSESSID=1&q=ok": "/p?q=ok"}.items():
        assert onion.canonical(raw, base) == (f"http://{a}.onion{want}", a)
    assert onion.canonical(f"HTTP://WWW.{a.upper()}.ONION:80", base)[0] == f"http://www.{a}.onion/"
    assert onion.canonical(f"https://{a}.onion:8443/a//b/../c", base)[0] == f"https://{a}.onion:8443/a/c"
    for bad in ("mailto:x@y", "http://example.com/", f"ftp://{a}.onion/", "data:text/html,hi", None, "http://[::1", "http://x:99999/"):
        assert onion.canonical(bad, None) is None


@given(st.text(alphabet="abc/.?&=#%: ", max_size=40))
@settings(max_examples=100, deadline=None)
def test_canonical_is_idempotent(s):
    u = onion.canonical_url("http://h.test/" + s)
    assert u is None or onion.canonical_url(u) == u


def test_hashes(spark):
    df = spark.createDataFrame([("abc",), (None,), ("",)], "a string")
    rows = df.select(hashing.md5_pair(F.col("a")).alias("m"), hashing.fnv1a64("a").alias("f"), hashing.simhash("a").alias("s")).collect()
    assert rows[0].m[1] == "900150983cd24fb0d6963f7d28e17f72" and rows[0].m[0] != rows[0].m[1]
    assert rows[1].f is None and rows[1].s is None and rows[2].s == 0
    assert hashing.fnv1a64_many([b"the quick fox"])[0] == 1363899492176631586


@given(st.lists(st.sampled_from("amber birch cedar delta ember fjord grove haven inlet jetty".split()), min_size=60, max_size=90), st.integers(0, 50))
@settings(max_examples=30, deadline=None)
def test_simhash_moves_less_for_one_word_than_for_all(ws, at):
    edited = [*ws[:at], "quartz", *ws[at + 1 :]]
    one, near, other = hashing.simhash_many([" ".join(ws), " ".join(edited), " ".join(f"{w}{i}" for i, w in enumerate(ws))])
    bits = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
    assert bits(one, near) < bits(one, other) or bits(one, other) >= 32 > bits(one, near)


def test_simhash_of_nothing():
    assert list(hashing.simhash_many(["", "  .. "])) == [0, 0] and hashing.simhash_many(["lone"])[0] != 0


def test_words():
    assert words.words("Ab½c d_e İx 9é") == ["ab", "c", "d", "e", "i̇x", "9é"]


ONION = onion.address_of(b"\x2a" * 32)
KEY = "-----BEGIN PGP PUBLIC KEY BLOCK-----\nabc/def\n-----END PGP PUBLIC KEY BLOCK-----"


@pytest.mark.parametrize("text,want", [
    ("send to bc1q" + "p" * 38 + ", thanks", [("btc", "bc1q" + "p" * 38)]),
    ("BC1Q" + "Z" * 30, [("btc", "bc1q" + "z" * 30)]),
    ("old form 3" + "K" * 30 + " is fine", [("btc", "3" + "K" * 30)]),
    ("x3" + "K" * 30, []),  # within a word
    ("0x" + "AbCd" * 10 + ";", [("eth", "0x" + "abcd" * 10)]),
    ("0x" + "ab" * 19, []),  # too short
    ("4A" + "9" * 93, [("xmr", "4A" + "9" * 93)]),
    ("Write Keeper.One@Inbox.example or keeper.one@inbox.EXAMPLE", [("email", "keeper.one@inbox.example")]),
    (f"at HTTP://{ONION.upper()}.onion/x", [("onion", ONION)]),
    ("nothing here", []), ("", []),
])
def test_entities(spark, text, want):
    (row,) = spark.createDataFrame([(text, "")], "t string, own string").select(entities.entities(F.col("t"), F.col("own")).alias("e")).collect()
    assert [tuple(e) for e in row.e] == want


def test_entities_know_keys_by_content_and_leave_out_the_page_itself(spark):
    rows = spark.createDataFrame([(KEY + " " + ONION + ".onion", ONION), (KEY.replace("\n", " \r\n "), ""), (None, "")], "t string, own string").select(entities.entities(F.col("t"), F.col("own")).alias("e")).collect()
    assert [e.kind for e in rows[0].e] == ["pgp"] == [e.kind for e in rows[1].e] and rows[0].e == rows[1].e and rows[2].e is None


def test_filter_terms(tmp_path, spark):
    path = tmp_path / "terms"
    path.write_text("# kept by hand\n\nblue heron\n ~seagull\nÉtang Gelé\n", encoding="utf-8")
    t = terms.Terms.load(str(path))
    assert len(t) == 3
    for sep in (" ", "  ", "\n", "-", "/", "..."):
        assert t.match(f"we saw a Blue{sep}HERON at noon")
    for whole in ("theseagulls", "s e a g u l l", "x/seaGULL7/y", "ｓｅａｇｕｌｌ", "étang gelé", "ETANG GELE"):
        assert t.match(whole)
    for other in ("blue herons", "bluebird heron", "heron blue", "sea gul", "etang", " ", "", None):
        assert not t.match(other)
    assert t.match(None, "", "blue heron") and not t.match()
    for bad in ([], ["#a"], ["~", " ~ "]):
        with pytest.raises(ValueError):
            terms.Terms(bad)
    with pytest.raises(OSError):
        terms.Terms.load(str(tmp_path / "none"))
    df = spark.createDataFrame([("one seagull", None), (None, "heron"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(terms.matches(spark, t, F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_outcomes(spark):
    rows = [(404, "text/html", 1, "<html>", None, "http_error"), (200, "image/png", 1, "x", None, "content_type"), (200, "text/html", 3 << 20, "<html>", None, "too_large"), (200, "text/html", 9, "\x00\x01", None, "sniff"), (200, None, 9, "plain", None, "sniff"), (200, None, 9, "<!DOCTYPE html>", None, "ok"), (None, None, None, None, "timeout", "timeout"), (200, "text/html; charset=x", 9, "hello", None, "ok")]
    df = spark.createDataFrame(rows, "s int, c string, n long, h string, e string, want string")
    for r in df.select(fetching.outcome(F.col("s"), F.col("c"), F.col("n"), F.col("h"), F.col("e")).alias("got"), "want").collect():
        assert r.got == r.want


def test_few_keys_move_when_a_proxy_is_added(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    pick = lambda n: fetching.pick_proxy([f"p{i}" for i in range(n)])("k")
    rows = df.select(pick(5).alias("a"), pick(6).alias("b")).collect()
    assert len({r.a for r in rows}) == 5 and sum(r.a != r.b for r in rows) <= 300
