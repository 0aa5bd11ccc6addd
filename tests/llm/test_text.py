"""Tokenisation, packing, secrets and main text against the libraries and against plain readings."""

import hashlib
import html
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm import queries as L
from millrace.llm.bpe import WordBPE, encode_decode
from millrace.llm.html_text import extract_main_text, main_text
from millrace.llm.packing import pack
from millrace.llm.secrets import BASE_RULES, MORE_RULES, Rule, Scanner, scan_secrets, trigram_query
from millrace.llm.token_counts import count_tokens

PARTS = [" ", "  ", "\n", " \n", "\t", "a", "the", "don't", "'s", "123", "½", "<|endoftext|>", "<|startoftext|>", "<|endof", "\x1c", "\x85", "\xa0", "é", "É", "中", "́", "!", "...", "Σ", "ΑΣ", "😀", "İ", "ſ", "ß", "aaaa", "AKIA", "ABCDEFGH1234567890", "token", "Secret", " = ", '"', "0123456789abcdef", "api_key", "Ж", "​"]
random.seed(5)
TEXTS = [None, "", " ", "word", "x" * 30000, "of the " * 9000] + ["".join(random.choices(PARTS, k=random.randint(0, 25))) for _ in range(400)]
SCHEMA = "doc_id long, text string, n_tokens int, ids string, sequence_id int, part int"


@pytest.fixture(scope="module")
def docs(spark):
    """All odd cases with ids, a null id, a repeated row, and columns whose names the operators use themselves."""
    rows = [(i, t, 1, "x", 2, 3) for i, t in enumerate(TEXTS)] + [(None, "null id", 1, "x", 2, 3), (3, TEXTS[3], 1, "x", 2, 3)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_bpe_is_the_librarys(docs, nothing):
    t = library("word_bpe_49k.json")
    got = encode_decode(docs).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        text = "null id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        ids = t.encode(text, add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == t.decode(ids, skip_special_tokens=False)
    assert encode_decode(nothing).collect() == []


def test_bpe_of_long_words():
    rng = random.Random(1)
    path = public_tokenizers.path("word_bpe_49k.json")
    bpe, t = WordBPE(path), library("word_bpe_49k.json")
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=100_000)), "a" * 201, "".join(rng.choices("abé中", k=3000)), "the" * 300, "short", "".join(rng.choices("etaoin", k=200))]
    began = time.perf_counter()
    ids, sizes = bpe.merge(words)
    assert time.perf_counter() - began < 20
    assert ids.tolist() == [i for w in words for i in t.encode(w, add_special_tokens=False).ids] and sizes.sum() == len(ids)


def test_bpe_query(spark, sf):
    t = library("word_bpe_49k.json")
    texts = {r.doc_id: r.text for r in L.table(spark, sf, "documents").collect()}
    for r in L.op2_bpe(spark, sf).collect():
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))


def test_counts_are_the_librarys(docs, nothing):
    t = library("byte_bpe_50k.json")
    for r in count_tokens(docs).collect():
        text = "null id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        n = len(t.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 1024)
    assert count_tokens(docs).count() == len(TEXTS) + 2
    assert count_tokens(nothing).collect() == []


@pytest.mark.parametrize("size,most_open", [(1024, 32), (64, 1), (100, 4)])
def test_packing_holds_every_id_once(docs, nothing, size, most_open):
    t = library("byte_bpe_50k.json")
    got = pack(docs, size=size, most_open=most_open, keep_ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for i, text in [*enumerate(TEXTS), (None, "null id")]:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        times = 2 if i == 3 else 1
        ordered = sorted(pieces[i], key=lambda r: r.start)
        assert sum(r.length for r in ordered) == times * len(ids) and all(r.doc_tokens == len(ids) for r in ordered)
        assert all(r.ids == ids[r.start : r.start + r.length] for r in ordered)
    total = 0
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        total += at
    # all but one sequence a partition are full
    assert len(sequences) <= total / size + 3
    assert pack(nothing).collect() == []


def plain_secrets(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_secrets(docs, nothing):
    kinds = [r.kind for r in BASE_RULES]
    some = 0
    for r in scan_secrets(docs, redact="#").collect():
        text = "null id" if r.doc_id is None else TEXTS[r.doc_id]
        want = plain_secrets(text or "")
        some += len(want)
        assert [(s.start, kinds.index(s.kind), s.end) for s in r.spans if s.base] == want
        assert (r.redacted is None) == (text is None)
        assert not want or plain_secrets(r.redacted) == [] or len(r.redacted) < len(text)
    assert some > 5
    assert scan_secrets(nothing).collect() == []


def test_further_rules_find_their_formats():
    real = {
        "github": "ghp_" + "a1B2" * 9, "slack": "xoxb-123456789012-abcdef", "jwt": "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSM", "private_key": "-----BEGIN RSA PRIVATE KEY-----",
    }
    near = {"github": "ghp_short", "slack": "xoxz-123456789012", "jwt": "eyJhbGci.eyJ.x", "private_key": "-----BEGIN PUBLIC KEY-----"}
    scanner = Scanner(MORE_RULES)
    for k, rule in enumerate(MORE_RULES):
        text = f"before {real[rule.kind]} after"
        assert scanner.scan([text, near[rule.kind]]) == [[(7, k, 7 + len(real[rule.kind]))], []]


def test_posting_lists_are_those_of_plain_search():
    scanner = Scanner([*BASE_RULES, *MORE_RULES, Rule("x", "naïve.*")])
    texts = [t or "" for t in TEXTS] + ["ab", "NAÏVE naïve", "tok", "en", "\x7f\x7ftok"]
    found = scanner.index(texts)
    assert {g: found[g].tolist() for g in scanner.indexed} == {g: [i for i, t in enumerate(texts) if g in t.lower()] for g in scanner.indexed}


def test_the_parse_tree_of_expressions_is_there():
    # secrets.py reads the standard library's own parse tree: this names what it needs, should a version move it
    from re import _constants, _parser

    tree = _parser.parse("a[bc](d|e)f+$")
    assert [op for op, _ in tree] == [_constants.LITERAL, _constants.IN, _constants.SUBPATTERN, _constants.MAX_REPEAT, _constants.AT]


def test_trigram_queries():
    assert trigram_query(BASE_RULES[2]) is True
    assert trigram_query(Rule("x", "ab.*cdef")) == ("and", frozenset({"cde", "def"}))
    assert trigram_query(Rule("x", "abc|xyz")) == ("or", frozenset({"abc", "xyz"}))
    assert trigram_query(Rule("x", "(abc)?d")) is True
    scanner = Scanner([Rule("x", "ab[0-9]cd+"), Rule("y", "(?:foo|ba[rz])+q"), Rule("z", "a{2,3}bcd")])
    for text in ("ab1cddd", "foobarq", "bazq", "aabcd aaabcd", "nothing", "AB1CD"):
        want = sorted((m.start(), k, m.end()) for k, (rule, _, _) in enumerate(scanner.rules) for m in re.finditer(rule.pattern, text))
        assert scanner.scan([text])[0] == want


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav><header>Top</header>
<div class="ad">Buy now, really.</div><div class="cookie-notice">We use cookies.</div><article><h1>Head &amp; more</h1><p><b>One  text,
with &lt;tags&gt;&nbsp;here.<br>Next line<p>Short.</p><aside>Side</aside><form><label>Mail</label><input></form><div class="comments"><p>I disagree, strongly.</p></div></article>
<!-- <p>gone</p> --><footer>&copy; foot</footer></body></html>"""


def test_main_text(spark):
    assert main_text(PAGE) == "Head & more\n\nOne text, with <tags> here. Next line\n\nShort."
    soup = "<body><div class='menu'>Home</div><div><h2>Title</h2><p>" + "Long text, with marks. " * 20 + "</p><p>" + "More text, again. " * 20 + "</p></div><div class='footer'>End</div></body>"
    assert main_text(soup).startswith("Title\n\nLong text") and "Home" not in main_text(soup) and "End" not in main_text(soup)
    assert main_text("") == "" and main_text("<script>x</script>") == "" and main_text("<p") == "<p"
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "u", "", "x"), (1, "u", PAGE, "x"), (4, "u", "<p>" + "very long, text. " * 20000, "x")]
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert sorted(r.text for r in got if r.page_id == 1) == [main_text(PAGE)] * 2


def test_main_text_of_whole_names_and_sentences():
    page = """<article><h2 id="cookies">How cookies work</h2><p>Cookies are small, really.</p><section id="related-work"><p>Others did this, too.</p></section>
    <div class="social-science">Science, social.</div><p>Press <button>OK</button> or <label>Go</label> now.</p><div class="share-links">Share, all of you.</div></article>"""
    assert main_text(page) == "How cookies work\n\nCookies are small, really.\n\nOthers did this, too.\n\nScience, social.\n\nPress OK or Go now."
    long = "A page in one form, all of it. " * 20
    assert main_text(f"<body><form><h1>T</h1><p>Lead, first.</p><p>{long}</p></form><div class='site-footer'>foot</div></body>").split("\n\n") == ["T", "Lead, first.", long.strip()]


def test_main_text_comes_from_the_ratios():
    text = "Long text, with marks. " * 20
    links = "".join(f"<div><span>link {i}</span></div>" for i in range(12))
    for page in (f"<div>{links}</div><div><h2>Title</h2><p>{text}</p><p>{text}</p></div>", f"<article><div>{links}</div><section><h2>Title</h2><p>{text}</p><p>{text}</p></section></article>"):
        assert main_text(page) == f"Title\n\n{text.strip()}\n\n{text.strip()}"


@pytest.mark.parametrize("page", ['<a "' * 250_000, "<div>" * 50_000 + "text, here." + "</div>" * 50_000, "<i><div>" + "<b>" * 50_000 + "x." + "</i>" * 50_000, "<div>" * 50_000 + "</span>" * 50_000, "<!--" * 200_000, "<" * 300_000, "<script>" + "</script" * 100_000])
def test_main_text_in_one_pass(page):
    began = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - began < 5


def test_main_text_of_nothing(spark):
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string, text string")).collect() == []


def test_main_text_query(spark, sf):
    # the pages of this table hold their article in one element; a second, plain reading of it must give the same text
    pages = {r.page_id: r.html for r in L.table(spark, sf, "pages").collect()}
    for r in L.op10_html_text(spark, sf).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", pages[r.page_id], re.S)[1]
        plain = re.sub(r"<(script|style|nav|footer|aside|form)\b.*?</\1>|<!--.*?-->", "", inner, flags=re.S)
        parts = [html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))) for p in re.split(r"</?(?:p|h1|h2|div|li|ul)\b[^>]*>", plain)]
        assert r.text == "\n\n".join(t for p in parts if (t := " ".join(p.split())))


LONG = "A sentence of the article, with marks and words. " * 6
PARAGRAPHS = "".join(f"<p>{LONG}{i}</p>" for i in range(6))
PLAIN = [f"{LONG}{i}" for i in range(6)]


@pytest.mark.parametrize("part, want", [
    ("<table><tr><th>Year</th><td>Sum</td></tr><tr><td>1999</td><td>7</td></tr></table>", ["Year", "Sum", "1999", "7"]), ("<ul><li>one</li><li>two</li></ul>", ["one", "two"]), ("<pre>x = 1\ny</pre>", ["x = 1 y"]),
    ("<figure><img src=x><figcaption>A caption</figcaption></figure>", ["A caption"]), ("<blockquote>Quoted words</blockquote>", ["Quoted words"]),
])
def test_main_text_keeps_the_parts_of_an_article(part, want):
    """Tables, lists, code, captions and quotations stay, in a box of their own too, in marked articles and without any mark."""
    for box in (part, f"<div>{part}</div>", f"<div class='wide'><div>{part}</div></div>"):
        for tag in ("article", "main", "div"):
            page = f"<body><nav>Menu</nav><{tag}><h1>Title</h1>{PARAGRAPHS}<h2>Part</h2>{box}<p>{LONG}6</p></{tag}><footer>foot</footer></body>"
            assert main_text(page).split("\n\n") == ["Title", *PLAIN, "Part", *want, f"{LONG}6"]


def test_main_text_without_longer_comments():
    comments = "".join(f"<p>{LONG * 3}reader {i}</p>" for i in range(5))
    for named in ('section class="comments"', 'div id="comments"', 'div class="comment-list"', 'section id="disqus"', 'div class="user-comments"', 'ol class="commentlist"'):
        tag = named.split()[0]
        for inner in (comments, f"<article>{comments}</article>", f"<h1>Comments</h1>{comments}"):
            assert main_text(f"<body><article><h1>Title</h1><p>Short, it is.</p><p>Over.</p></article><{named}>{inner}</{tag}></body>") == "Title\n\nShort, it is.\n\nOver."
            assert main_text(f"<body><div><h1>Title</h1><p>Short, it is, but long enough.</p></div><{named}>{inner}</{tag}></body>") == "Title\n\nShort, it is, but long enough."
            assert main_text(f"<div class='main-wrapper nav'><article><h1>Title</h1>{PARAGRAPHS}</article><{named}>{inner}</{tag}></div>").split("\n\n") == ["Title", *PLAIN]


def test_main_text_reads_attributes_by_name():
    for attributes in ('title="The hidden valley"', 'class="flex hidden lg:block"', 'data-id="footer"', 'data-role="dialog"', "data-hidden=1", 'aria-hidden="false"', 'alt="display:none"', 'data-class="ad"'):
        assert main_text(f"<article><p {attributes}>Here, it stays.</p><p>{LONG}</p></article>") == f"Here, it stays.\n\n{LONG.strip()}"
    for attributes in ("hidden", 'HIDDEN=""', 'aria-hidden="true"', "style='color:red; display : none'", 'role="dialog"', "class=ad", 'id="x" class="big ad-box"'):
        assert main_text(f"<article><div {attributes}><p>Gone, away.</p></div><p>{LONG}</p></article>") == LONG.strip()
    assert main_text("<article><p>Choose <select><option>A</option><option>B</option></select> now.</p></article>") == "Choose now."


def test_main_text_without_related_posts():
    for named in ("related-posts", "related articles", "search-form", "copyright", "ad-slot"):
        assert main_text(f"<article><h1>T</h1><p>{LONG}</p><div class='{named.split()[0]}'><p>Gone, away.</p></div></article>").split("\n\n") == ["T", LONG.strip()]
    for named in ("related-work", "research", "commentary", "comment-free-approach", "content"):
        assert main_text(f"<article><h1>T</h1><p>{LONG}</p><div class='{named}'><p>Here, it stays.</p></div></article>").split("\n\n") == ["T", LONG.strip(), "Here, it stays."]


def planted_page(rng):
    """A page and its truth: title, paragraphs, parts and noise around them, with and without marks."""
    words = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
    sentence = lambda: words(rng.randint(6, 16)).capitalize() + ", " + words(rng.randint(4, 9)) + "."
    truth, body = [words(4)], []
    body.append(f"<h1>{truth[0]}</h1>")
    for k in range(rng.randint(3, 9)):
        text = " ".join(sentence() for _ in range(rng.randint(2, 5)))
        truth.append(text)
        body.append(f"<p>{text}</p>")
        if rng.random() < 0.3:
            cells = [words(2) for _ in range(4)]
            truth += cells
            body.append(rng.choice(["<div><table><tr><td>{}</td><td>{}</td></tr><tr><td>{}</td><td>{}</td></tr></table></div>", "<ul><li>{}</li><li>{}</li><li>{}</li><li>{}</li></ul>"]).format(*cells))
    links = lambda n: "".join(f"<li><a href='/{i}'>{words(2)}</a></li>" for i in range(n))
    noise = [f"<div><ul>{links(8)}</ul></div>", f"<div>{''.join(f'<a href=/>{words(1)}</a> ' for _ in range(6))}</div>", f"<div class='ad'>{sentence()}</div>", f"<div><span>{words(3)}</span></div>", f"<div class='sidebar'><p>{sentence()}</p><ul>{links(5)}</ul></div>"]
    rng.shuffle(noise)
    comments = "<div id='comments'>" + "".join(f"<p>{' '.join(sentence() for _ in range(6))}</p>" for _ in range(rng.choice([0, 3, 12]))) + "</div>"
    tag = rng.choice(["article", "main", "div", "section", "div class='entry'"])
    inner = "".join(body)
    return f"<body>{noise[0]}{noise[1]}<{tag}>{inner}{noise[2]}</{tag.split()[0]}>{comments}{noise[3]}{noise[4]}<div>© {words(2)}</div></body>", truth


VOCABULARY = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("", "n", "st", "r")]


def test_main_text_of_planted_pages():
    rng, hit, found, wanted = random.Random(4), 0, 0, 0
    for _ in range(200):
        page, truth = planted_page(rng)
        got, want = Counter(main_text(page).split()), Counter(" ".join(truth).split())
        hit, found, wanted = hit + sum((got & want).values()), found + sum(got.values()), wanted + sum(want.values())
    assert 2 * hit / (found + wanted) >= 0.98
