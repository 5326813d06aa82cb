"""Chats, archives and pages: round trips, damage, held-out accuracy, odd rows."""

from __future__ import annotations

import base64
import hashlib
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import chat, extract, warc
from tidewatch.llm.labelled_pages import labelled_pages
from tidewatch.llm.queries import QUERIES
from tidewatch.llm.tables import table

FOLDER = "/root/testdata/sf0.001"
PARTS = ["<s>", "</s>", "[INST]", "[/INST]", "[ANS]", "<<SYS:", ">>", "<</SYS>>", "\\", " ", "a", "<", "[/", "INST]", "\n"]


# Chats -----------------------------------------------------------------------------------------

contents = st.lists(st.sampled_from(PARTS), max_size=8).map("".join) | st.text(max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]) | contents, contents), max_size=5))
def test_every_conversation_comes_back(turns):
    formatted = chat.render(turns)
    found = chat.parse(formatted)
    assert [(role, text) for role, text, _ in found] == turns
    assert all(chat._unescape(formatted[a:b]) == text for _, text, (a, b) in found)


def test_plain_texts_are_not_changed():
    assert chat.render([("user", "a \\ b"), ("assistant", "c")]) == "<s>[INST] a \\ b [/INST][ANS] c </s>"
    with pytest.raises(chat.NotInGrammar):
        chat.parse("<s>[INST] a [ANS] b </s>")


def test_chat_digests_of_odd_rows(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", said), (1, 0, "user", None), (2, 0, None, "x"), (2, 0, None, "x"), (None, 5, "assistant", ""), (3, None, "a>>b", "y" * 50_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS place", "2 AS segment")
    segments = chat.format_conversations(frame)
    found = {r.conv_id: r for r in chat.read_back(segments).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert set(found) == {1, 2, 3, None} and found[2].n_turns == 2
    assert found[1].turns_sha256 == sha(f"user\n\nassistant\n{said}\n")
    assert (found[1].loss_chars, found[1].loss_sha256) == (len(said), sha(said))
    whole = {r.conv_id: r.formatted for r in chat.whole_texts(segments).collect()}
    assert whole[1] == chat.render([("user", ""), ("assistant", said)]) and found[1].formatted_chars == len(whole[1])
    assert chat.read_back(chat.format_conversations(frame.where("false"))).count() == 0


# Archives --------------------------------------------------------------------------------------


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def expected_pages(rows, least=0):
    first: dict[bytes, int] = {}
    for page, _, html in rows:
        if page is not None:
            payload = (html or "").encode()
            first[payload] = max(first.get(payload, page), page)
    for page, _, html in rows:
        payload = (html or "").encode()
        revisit = len(payload) >= least and payload in first and first[payload] != page
        yield (page, len(payload), sha1(payload), "revisit" if revisit else "response", first[payload] if revisit else None)


ODD_PAGES = [
    (1, "http://a/", "same é"), (2, None, "same é"), (3, "x y\r\n", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.0\r\n"), (None, "n", "same é"),
    (5, "e", None), (6, "f", ""), (7, "g", "z" * 300_000), (7, "g", "z" * 300_000),
]


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("least", [0, 3])
def test_archives_come_back(spark, tmp_path, compress, least):
    frame = spark.createDataFrame(ODD_PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS revisit", "2 AS refers_to")
    warc.write_archives(frame, str(tmp_path / "w"), warc.WarcParams(least, compress, records_per_file=2))
    records = warc.read_archives(spark, str(tmp_path / "w"))
    assert records.where("kind = 'gap'").count() == 0
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, warc.page_table(records).collect()), key=key) == sorted(expected_pages(ODD_PAGES, least), key=key)


def test_archives_of_the_table(spark):
    pages = [tuple(r) for r in table(spark, FOLDER, "pages").collect()]
    found = QUERIES["op3_warc_archives"](spark, FOLDER).collect()
    assert sorted(map(tuple, found), key=str) == sorted(expected_pages(pages), key=str)


def archive(compress: bool, count: int = 6) -> tuple[bytes, list[int]]:
    data, starts = b"", []
    for i in range(count):
        record = warc.record_bytes(i, f"http://x/{i}", f"payload {i} ".encode() * 20, None, False, "2024-01-01T00:00:00Z")
        starts.append(len(data))
        data += warc._gzip(record + b"\r\n\r\n") + warc.EMPTY_MEMBER if compress else record + b"\r\n\r\n"
    return data, [*starts, len(data)]


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("hit", range(6))
def test_later_records_are_salvaged(compress, hit):
    data, starts = archive(compress)
    broken = bytearray(data)
    at = (starts[hit] + starts[hit + 1]) // 2
    broken[at : at + 4] = b"\x00\xff\x00\xff"
    found = list(warc.salvage(bytes(broken)))
    good = [r["record_id"] for r in found if r["kind"] == "record"]
    assert good == [f"<urn:page:{i}>" for i in range(6) if i != hit]
    gaps = [r for r in found if r["kind"] == "gap"]
    assert gaps and gaps[0]["offset"] == starts[hit] and gaps[0]["reason"]
    # Every byte is in a record or a gap, or in an empty member.
    assert sum(r["length"] for r in found) + 20 * compress * 6 >= len(data)


def test_truncated_and_foreign_bytes():
    data, starts = archive(True)
    found = list(warc.salvage(b"junk\x1f\x8b\x08" + data[: starts[3] + 30]))
    assert [r["kind"] for r in found] == ["gap", "record", "record", "record", "gap"]
    assert found[0]["length"] == 7 and list(warc.salvage(b"")) == []


# Pages -----------------------------------------------------------------------------------------


def test_messages_give_the_exact_marginals():
    model = extract.built_in_model()
    page = extract.parse_page("<body><nav><a>x</a></nav><article><p>One two three.</p><div class=ad>Buy</div></article></body>")
    own, n = model.own(page), len(page.parent)
    odds = model.messages(page)[2]
    mass = [[0.0, 0.0] for _ in range(n)]
    for bits in range(2**n):
        state = [bits >> i & 1 for i in range(n)]
        log = sum(own[i] for i in range(n) if state[i])
        for i in range(1, n):
            pair = (state[page.parent[i]], state[i])
            log += dict(zip(((0, 1), (1, 0), (1, 1)), model.edges[page.text[i] is not None])).get(pair, 0.0)
        for i in range(n):
            mass[i][state[i]] += math.exp(log)
    assert odds == pytest.approx([math.log(b / a) for a, b in mass], abs=1e-6)


def test_held_out_pages():
    model, right, total = extract.built_in_model(), 0, 0
    for source in labelled_pages(100, seed=9):
        page = extract.parse_page(source)
        labels, odds = extract.node_labels(page), model.messages(page)[2]
        blocks = [i for i, t in enumerate(page.text) if t is not None]
        right += sum((odds[i] > 0) == labels[i] for i in blocks)
        total += len(blocks)
    assert right >= 0.98 * total


def test_blocks_and_references():
    model = extract.built_in_model()
    source = (
        "<html><head><title>T</title><script>a='<p>no</p>'</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav>"
        "<article><h1>A &amp; B</h1><p>First&nbsp; line\n of <b>text</b>.<br>More &eacute;.<p>Second block, with enough words in it.</p></article>"
        '<section class="comments"><h3>Comments</h3><div class="comment"><p>So good, thank you!</p></div></section>'
        "<footer>&copy; site</footer></body></html>"
    )
    assert extract.main_text(model, source) == "A & B\n\nFirst line of text. More é.\n\nSecond block, with enough words in it."
    for odd in (None, "", "<", "<<<>>>", "</p></div>", "<p", "<!--", "<script>", "<div " * 500, "<b>" * 3000 + "x"):
        assert isinstance(extract.main_text(model, odd), str)


def test_pages_of_the_table(spark):
    rows = {r.page_id: r for r in QUERIES["op6_main_text"](spark, FOLDER).collect()}
    pages = table(spark, FOLDER, "pages").collect()
    assert len(rows) == len(pages)
    for page in pages:
        r = rows[page.page_id]
        assert r.n_chars == len(r.text) and r.url == page.url
        if "<article>" in page.html:
            title = page.html.split("<h1>")[1].split("</h1>")[0]
            assert r.text.startswith(" ".join(__import__("html").unescape(title).split()))
    odd = spark.createDataFrame([(1, None, None, 3), (1, "u", "", 4)], "page_id long, url string, html string, text int")
    assert [(r.text, r.n_chars) for r in extract.extract(odd).collect()] == [("", 0), ("", 0)]
    assert extract.extract(odd.where("false")).count() == 0


def test_names_are_found_anywhere_in_attributes():
    utility = " ".join(f"{a}-{b}" for a in ("flex", "px", "md", "row") for b in ("aa", "bb", "cc", "dd"))
    for attrs in (f"style='{'x' * 5000}' class='sidebar'", f"class='{utility} sidebar'"):
        page = extract.parse_page(f"<body><div {attrs}>text</div></body>")
        assert "sidebar" in page.names[page.tag.index("div")]


_TEXT = " ".join(["A sentence of the article that is long enough to read."] * 8)
_MENU = "<nav><ul><li><a href=/>Home</a></li><li><a href=/b>News</a></li></ul></nav>"
_FOOT = "<footer>&copy; site, all rights reserved</footer>"
_TITLE = "<h1>Title of it</h1>"
WRITTEN = {
    "one paragraph": (f"<html><head><title>x</title></head><body>{_MENU}<article><p>{_TEXT}</p></article>{_FOOT}</body></html>", [_TEXT]),
    "one paragraph in a div": (f"<body>{_MENU}<div id=main><p>{_TEXT}</p></div>{_FOOT}</body>", [_TEXT]),
    "nothing around it": (f"<body><p>{_TEXT}</p></body>", [_TEXT]),
    "no markup": (_TEXT, [_TEXT]),
    "head without an end": (f"<head><title>x</title><h1>Head line</h1><p>{_TEXT}</p>", ["Head line", _TEXT]),
    "heading of one letter": (f"<body>{_MENU}<article><h1>A</h1><p>{_TEXT}</p><p>{_TEXT}</p></article>{_FOOT}</body>", ["A", _TEXT, _TEXT]),
    "unclosed button": (f"<article>{_TITLE}<p>{_TEXT}</p><button><p>{_TEXT}</p><p>{_TEXT}</p></article>{_FOOT}", ["Title of it", _TEXT, _TEXT, _TEXT]),
    "unclosed and closed button": (
        f"<article>{_TITLE}<button><p>{_TEXT}</p><button>OK</button><p>{_TEXT}</p></article>{_FOOT}", ["Title of it", _TEXT, _TEXT],
    ),
    "unclosed object": (f"<article>{_TITLE}<object data=x><p>{_TEXT}</p><p>{_TEXT}</p></article>{_FOOT}", ["Title of it", _TEXT, _TEXT]),
    "unclosed svg in an unclosed svg": (f"<article>{_TITLE}<svg><svg><p>{_TEXT}</p></article>{_FOOT}", ["Title of it", _TEXT]),
    "svg in svg": (f"<article>{_TITLE}<p><svg><svg><text>no</text></svg>no</svg>{_TEXT}</p></article>{_FOOT}", ["Title of it", _TEXT]),
    "end tag beyond the article": (f"<article>{_TITLE}<div><select><option>no</div><p>{_TEXT}</p></article></select>{_FOOT}", ["Title of it", _TEXT]),
    "video with a fallback": (f"<article>{_TITLE}<video><p>no</p></video><p>{_TEXT}</p></article>{_FOOT}", ["Title of it", _TEXT]),
    "responses of readers": (
        f"<article>{_TITLE}<p>{_TEXT}</p></article><div class='user-responses'><p>Great post, thank you very much for it!</p></div>{_FOOT}",
        ["Title of it", _TEXT],
    ),
    "very long": (f"<body>{_MENU}<article>{_TITLE}" + f"<p>{_TEXT}</p>" * 3_000 + f"</article>{_FOOT}</body>", ["Title of it", *[_TEXT] * 3_000]),
}


@pytest.mark.parametrize("name", WRITTEN)
def test_written_pages(name):
    source, blocks = WRITTEN[name]
    assert extract.main_text(extract.built_in_model(), source) == "\n\n".join(blocks)
