"""Main text: languages without stop words, lists inside articles, very deep pages, and a plain slow extractor."""
import time
from html.parser import HTMLParser

import pytest

from starloom.llm import html_text as H

LONG = "word the of and " * 20
FOREIGN = ["Это длинный абзац текста без известных слов. " * 6, "これは知られていない言語で書かれた長い段落です。" * 8,
           "Lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt. " * 4]


@pytest.mark.parametrize("text", FOREIGN)
def test_languages_without_known_words(text):
    text = text.strip()
    page = f"<body><nav><ul><li><a href=/a>Menu item</a></li></ul></nav><div><p>{text}</p><p>{text}</p></div><div><a href=/x>{text}</a></div><footer>{text}</footer></body>"
    assert H.extract(page) == f"{text}\n\n{text}"
    # where the page's own words are known, density still decides
    english = LONG.strip()
    assert H.extract(f"<div><p>{english}</p></div><div><p>{english}</p></div><div>{'xq zzv ' * 15}</div><div><p>{english}</p></div>") == "\n\n".join([english] * 3)


def test_lists_inside_the_main_region():
    text, link, plain = LONG.strip(), "<li><a href=x>link item</a></li>", "<li>plain item</li>"
    item = lambda page: H.extract(page).split("\n\n")
    assert item(f"<article><p>{text}</p><ul>{link}{plain}</ul></article>") == [text, "link item", "plain item"]          # text of its own
    assert item(f"<article><p>{text}</p><ul>{link}{link}</ul><p>{text}</p></article>") == [text, "link item", "link item", text]  # between text
    assert item(f"<article><p>{text}</p><ul>{link}{link}</ul></article>") == [text]                                    # a list of links at the edge
    assert item(f"<article><ul>{link}{link}</ul><p>{text}</p><ol>{plain}<li><ul>{link}</ul></li></ol></article>") == [text, "plain item", "link item"]
    assert item(f"<body><article><p>{text}</p></article><ul>{link}</ul></body>") == [text]


@pytest.mark.parametrize("piece", ["<div>x ", "<b>x ", "<p><b>x ", "<ul><li>x ", "<li>x ", "</b>x <i>", "<table><tr><td>x ", "<p>x </div>", "<a>x <div>", "<section class=ad>x "])
def test_time_is_linear_in_open_elements(piece):
    def seconds(n):
        t = time.process_time()
        H.extract(piece * n)
        return time.process_time() - t
    seconds(1000)
    short, long = min(seconds(10_000) for _ in range(2)), min(seconds(20_000) for _ in range(2))
    assert long < 2 and long < 3.2 * short + .05


class Plain(HTMLParser):
    """Blocks by looking through the whole stack at every step."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.stack, self.blocks, self.parts, self.links, self.where = [], [], [], 0, None

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append((text, self.links, *self.where))
        self.parts, self.links = [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.handle_data(" ")
        if tag not in H.INLINE:
            self.flush()
        if tag in H.VOID:
            return
        closes = H.IMPLIED.get(tag, ("p",) if tag not in H.INLINE else ())
        for old in closes:
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] == old:
                    del self.stack[k:]
                    break
                if self.stack[k][0] in H.SCOPE:
                    break
        words = {x for k, v in attrs if k in ("class", "id") for x in (v or "").split()}
        self.stack.append((tag, tag in H.BAD_TAGS | {"head"} or bool(words & H.BAD_WORDS) and tag not in H.WHOLE_TAGS, tag in H.RAW))

    def handle_endtag(self, tag):
        if tag not in H.INLINE:
            self.flush()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                return
            if tag in H.INLINE and self.stack[k][0] not in H.INLINE:
                return

    def handle_data(self, text):
        tags = [t for t, _, _ in self.stack]
        if any(raw for _, _, raw in self.stack):
            return
        if not self.parts:
            self.where = any(b for _, b, _ in self.stack), any(t in H.MAIN_TAGS for t in tags), any(t in H.HEADINGS for t in tags), "li" in tags
        self.parts.append(text)
        self.links += len(text.strip()) if "a" in tags else 0

    def handle_entityref(self, name):
        import html
        self.handle_data(html.unescape(f"&{name};"))

    def handle_charref(self, name):
        import html
        self.handle_data(html.unescape(f"&#{name};"))


def plain_extract(page, r=H.Rules()):
    p = Plain()
    p.feed(page)
    p.flush()
    labels = []
    for text, links, bad, main, _, item in p.blocks:
        words = H.WORD.findall(text.lower())
        stop = sum(w in H.STOP_WORDS for w in words) / max(1, len(words))
        if bad or links > r.max_link * len(text) and not main:
            labels.append("bad")
        elif len(text) < r.length_low:
            labels.append("bad" if links and not main else "short")
        elif main or stop >= r.stop_high and len(text) > r.length_high:
            labels.append("good")
        else:
            labels.append("neargood" if stop >= r.stop_low else "bad")
    declared, out = any(b[3] for b in p.blocks), []
    for i, (text, links, bad, main, heading, _) in enumerate(p.blocks):
        vote = lambda order: next((labels[j] for j in order if labels[j] in ("good", "bad") and not p.blocks[j][2] and p.blocks[j][3] == main), "")
        before, after = vote(range(i - 1, -1, -1)), vote(range(i + 1, len(p.blocks)))
        near = {before, after} - {""}
        if labels[i] in ("good", "bad"):
            keep = labels[i] == "good"
        elif main or near == {"good"}:
            keep = True
        elif len(near) == 2:
            keep = labels[i] == "neargood" or heading and after == "good"
        else:
            keep = not near and not declared and not links
        if keep:
            out.append(text)
    return "\n\n".join(out)


def test_query_equals_the_plain_extractor(spark):
    from starloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op10_main_text"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == plain_extract(pages[r.page_id].html or ""), r.page_id
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url
