from pyspark.sql import functions as F

from newsloom.functions import images as I
from newsloom.functions import text as X
from newsloom.functions import urls as U

BASE = "https://example.com/news/page?x=1"
URLS = [
    ("first?edition=1#top", "https://example.com/news/first?edition=1"),
    ("../about", "https://example.com/about"),
    ("//cdn.example/a.jpg", "https://cdn.example/a.jpg"),
    ("?q=2", "https://example.com/news/page?q=2"),
    ("#frag", "https://example.com/news/page?x=1"),
    (" /für ", "https://example.com/f%C3%BCr"),
    ("http://user@h.example/", ""),
    ("javascript:alert(1)", ""),
    ("mailto:a@b.example", ""),
    ("/bad%zz", ""),
    ("a:b", ""),
    ("", ""),
    ("/a/./b/../c/", "https://example.com/a/c/"),
    ("HTTPS://H.example", "https://H.example"),
    ("/with space", "https://example.com/with%20space"),
]


def test_resolve(values):
    assert values([r for r, _ in URLS], lambda c: U.resolve_url(F.lit(BASE), c)) == [w for _, w in URLS]


def test_fold_agrees_with_the_driver_side(values):
    samples = ["ΣΑΣ", "Straße", "ſet", "İstanbul", "µm", "A  b\tc", "ÉCOLE"]
    assert values(samples, X.fold) == [X.fold_text(s) for s in samples]
    assert X.fold_text("ΣΑΣ") == X.fold_text("σας") and X.fold_text("ß") != X.fold_text("ss")


def test_redaction(values):
    got = values(
        ["at https://a.example/x?k=1 end", "Authorization: Bearer abc\nnext", 'api_key = "a b", ok', 'token = "kept"'], lambda c: X.redact(c, 200)
    )
    assert got == ["at [URL omitted] end", "Authorization: [redacted]\nnext", "api_key=[redacted], ok", 'token = "kept"']


def test_bounds_never_split_a_character(values):
    assert values(["aéé", "abc"], lambda c: X.clip_bytes(c, 4)) == ["aé", "abc"]
    assert values(["x" * 121, "y" * 120], lambda c: X.ellipsize(c, 120)) == ["x" * 119 + "…", "y" * 120]


def test_escapes(values):
    assert values(["a&<\"'>"], X.escape_html) == ["a&amp;&lt;&#34;&#39;&gt;"]
    assert values(['q"\\\n'], X.escape_label) == ['q\\"\\\\\\n']
    assert values(["a\r\n\nb"], X.one_line) == ["a b"]


def test_srcset(values):
    lists = ["/a.jpg 1x, /b.jpg 2x", "a.jpg,b.jpg", "/w_4,h_3/a.jpg 4w, /x.png", "data:image/gif;base64,AA 1x, /q.webp 2x", "a.png,", ""]
    assert values(lists, lambda c: F.array_join(I.srcset_candidates(c), "|")) == [
        "/a.jpg|/b.jpg", "a.jpg|b.jpg", "/w_4,h_3/a.jpg|/x.png", "data:image/gif;base64,AA|/q.webp", "a.png", "",
    ]


def test_image_addresses(values):
    good = ["/a.jpg", "a.PNG", "https://c.example/render?id=1", "./thumb", "../x/y"]
    bad = ["true", "12", ".jpg", "/v.mp4/", "/9j/AAA", "foo/bar", "/dir/", "a b.jpg", "ftp://h/a.jpg", "/a.jpg,/b.jpg", "{x}.jpg"]
    assert values(good, I.is_image_address) == [True] * len(good)
    assert values(bad, I.is_image_address) == [False] * len(bad)
