"""Which parts of a page are content: single cases, and made pages against an independent extractor over a tree."""

import math
import random
import xml.etree.ElementTree as ET

import pytest

from lodestrata.llm import html_text

LONG = "word " * 60 + "end"


@pytest.mark.parametrize("page, want", [
    (f"<body><form id=aspnet><div id=content><p>{LONG}</p><p>short</p></div></form></body>", f"{LONG}\nshort"),
    (f"<body><form><article><h1>Title</h1><p>{LONG}</p></article></form></body>", f"Title\n{LONG}"),
    (f"<body><form><label>Name</label><input><p>{LONG}</p><button>Go</button></form></body>", LONG),
    (f"<article><header><h1>Title</h1><p>By someone</p></header><p>{LONG}</p></article>", f"Title\nBy someone\n{LONG}"),
    (f"<body><header><h2>The Site</h2><p>motto</p></header><article><p>{LONG}</p></article></body>", LONG),
    (f"<article><p>{LONG}</p><form><p>Your mail</p><input></form></article>", LONG),
    *((f'<main><p>{LONG}</p><p>{LONG}</p><div class="{name}"><p>Some words there</p></div></main>', f"{LONG}\n{LONG}") for name in ("ad-slot", "cookie-bar", "related-posts", "post-comments", "comment-list", "user-comments", "AdContainer", "share-buttons")),
    *((f'<main><p>{LONG}</p><div class="{name}"><p>Some words there</p></div></main>', f"{LONG}\nSome words there") for name in ("post-content", "entry-body", "no-ads", "with-sidebar", "article-header", "grad", "headers-and-more")),
    (f'<article><p>{LONG}</p></article><section class="comment-list"><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></section>', LONG),
    (f'<main><p>{LONG}</p><section class="comment-list"><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></section></main>', LONG),
    (f'<article><p>{LONG}</p><p style="display: none">gone</p><div style="color:red;VISIBILITY:hidden">gone</div><p style="display:block">seen</p></article>', f"{LONG}\nseen"),
    (f"<article><p>{LONG}</p><ul><li><a href=/>One link</a></li><li><a href=/>Two links</a></li></ul><ul><li>a</li><li>b</li></ul></article>", f"{LONG}\na\nb"),
    (f"<main><article><p>{LONG}</p><p>{LONG}</p></article></main><article><a href=/>Another story</a></article>", f"{LONG}\n{LONG}"),
    ("<body><ul><li><a href=/>Only</a></li><li><a href=/>links</a></li></ul></body>", "Only\nlinks"),
])
def test_regions(page, want):
    assert html_text.extract(page) == want


# ---- an independent extractor for well-formed pages ----

SKIP = set("script style noscript template nav footer aside menu button select textarea label legend datalist iframe svg math object head title dialog".split())
BLOCK_TAGS = html_text.BLOCKS


class Leaf:
    def __init__(self, text, tags, path, linked):
        self.text, self.tags, self.path, self.linked = text, tags, path, linked


def leaves(root):
    """Lines of a tree, each with the elements around it; text and tags are told apart by one walk over all events."""
    events, out, state = [], [], {"text": [], "tags": 0, "linked": 0, "path": ()}

    def visit(e, path, links):
        path = (*path, e)
        events.append(("start", e, path, links))
        if e.tag in SKIP or "hidden" in e.attrib or "none" in e.attrib.get("style", ""):
            events[-1] = ("skip", e, path, links)
        else:
            events.append(("text", e.text or "", path, links + (e.tag == "a")))
            for c in e:
                visit(c, path, links + (e.tag == "a"))
                events.append(("text", c.tail or "", path, links + (e.tag == "a")))
        events.append(("end", e, path, links))

    def flush(path):
        text = " ".join("".join(state["text"]).split())
        if text:
            out.append(Leaf(text, state["tags"], state["path"], 2 * state["linked"] > len(text)))
        state.update(text=[], tags=0, linked=0)

    visit(root, (), 0)
    for kind, what, path, links in events:
        if kind == "text":
            state["text"].append(what)
            state["linked"] += len(" ".join(what.split())) if links else 0
            if what.strip():
                state["path"] = path
        else:
            if what.tag in BLOCK_TAGS:
                flush(path)
            state["tags"] += what.tag != "input" or kind != "end"
    flush(())
    return out


def brute_clusters(lines):
    ratio = [len(x.text) / max(1, x.tags) for x in lines]
    spread = lambda v: math.sqrt(sum((a - sum(v) / len(v)) ** 2 for a in v) / len(v))
    smooth = []
    for i in range(len(ratio)):
        near = [(math.exp(-((j - i) ** 2) / 8), ratio[j]) for j in range(max(0, i - 6), min(len(ratio), i + 7))]
        smooth.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    least = min(max(smooth), max(spread(smooth), 1e-9))
    return [s >= least for s in smooth], [s >= least and r >= max(least, min(spread(ratio), 40)) for s, r in zip(smooth, ratio)]


def brute_extract(html):
    lines = leaves(ET.fromstring(html))
    inside, _ = brute_clusters(lines)
    mass = lambda test: sum(len(x.text) for x, c in zip(lines, inside) if c and test(x))
    named_at = lambda path: next((k for k, e in enumerate(path) if e.tag in ("article", "main")), None)

    def beside(path):
        """(element, its outermost named ancestor or None, hardly ever content) of each part beside the article."""
        for k, e in enumerate(path):
            never = e.attrib.get("class") in ("comment-list", "ad-slot")
            if never or e.attrib.get("class") == "related-posts" or e.tag == "form" or e.tag == "header" and named_at(path[:k]) is None:
                yield e, named_at(path[:k]) is not None, never

    free = any(c and named_at(x.path) is not None and not list(beside(x.path)) for x, c in zip(lines, inside))
    whole = mass(lambda x: True)
    content = lambda e, named, never: mass(lambda x: e in x.path) > (0.9 if never else 0.5) * whole and (named or not free)
    lines = [x for x in lines if all(content(*b) for b in beside(x.path))]
    if not lines:
        return ""
    inside, dense = brute_clusters(lines)
    outermost = lambda x: None if named_at(x.path) is None else x.path[named_at(x.path)]
    if any(outermost(x) is not None for x in lines) and mass(lambda x: outermost(x) is not None) >= mass(lambda x: outermost(x) is None):
        good = [outermost(x) for x, c in zip(lines, inside) if c and not x.linked and outermost(x) is not None]
        keep = [outermost(x) is not None and (not good or outermost(x) in good) for x in lines]
    else:
        wide = [x for x, c, d in zip(lines, inside, dense) if c and not x.linked and (d or any(e.tag in html_text.HEADINGS for e in x.path[-3:]))] or [x for x, c in zip(lines, inside) if c]
        chains = [[e for e in x.path if e.tag in ("div", "section", "body", "article", "main")] for x in wide]
        shared = [level[0] for level in zip(*chains) if all(e is level[0] for e in level)]
        keep = [not shared or shared[-1] in x.path for x in lines]
    menu = lambda e: all(x.linked and not d for x, d in zip(lines, dense) if e in x.path) and sum(e in x.path for x in lines) >= 2
    holds = [any(e.tag in ("div", "section", "ul", "ol", "table", "header") and menu(e) for e in x.path) for x in lines]
    found = [x.text for x, k, m in zip(lines, keep, holds) if k and not m]
    return "\n".join(found or [x.text for x, k in zip(lines, keep) if k])


def mixed_page(r):
    """A page with an article or main among menus, forms, adverts, comments and teasers."""
    say = lambda n: " ".join(r.choice(["river", "stone", "walk", "light", "seven", "under"]) for _ in range(n))
    links = lambda n: "<ul>" + "".join(f"<li><a href='/'>{say(2)}</a></li>" for _ in range(n)) + "</ul>"
    extras = [lambda: links(r.randint(2, 5)), lambda: f"<div>{links(3)}</div>", lambda: f"<div class='ad-slot'><p>{say(8)}</p></div>", lambda: f"<ul><li>{say(2)}</li><li>{say(3)}</li></ul>", lambda: f"<form><p>{say(4)}</p><input/></form>", lambda: f"<div class='related-posts'>{links(3)}<p>{say(20)}</p></div>", lambda: f"<section class='comment-list'><p>{say(r.randint(5, 60))}</p></section>", lambda: f"<p><a href='/'>{say(3)}</a></p>", lambda: f"<p style='display:none'>{say(30)}</p>", lambda: f"<h3>{say(3)}</h3>"]
    body = "".join(f"<p>{say(r.randint(15, 80))}</p>" + (r.choice(extras)() if r.random() < 0.5 else "") for _ in range(r.randint(2, 8)))
    head = r.choice(["", f"<h1>{say(4)}</h1>", f"<header><h1>{say(4)}</h1><p>{say(3)}</p></header>"])
    content = r.choice(["<article>{}</article>", "<main>{}</main>", "<form><article>{}</article></form>", "<form><main><div>{}</div></main></form>", "<div><div>{}</div></div>"]).format(head + body)
    teaser = r.choice(["", f"<article><a href='/'>{say(4)}</a></article>", f"<div><h2>{say(2)}</h2>{links(2)}</div>"])
    return f"<html><head><title>{say(3)}</title></head><body><header><p>{say(2)}</p></header><nav>{links(3)}</nav>{r.choice(extras)()}{content}{teaser}<footer>{say(4)}</footer></body></html>"


def test_made_pages_against_a_tree(monkeypatch):
    r = random.Random(31)
    pages = [mixed_page(r) for _ in range(400)]
    got = [html_text.extract(p) for p in pages]
    wrong = [k for k, p in enumerate(pages) if got[k] != brute_extract(p)]
    assert not wrong, (len(wrong), pages[wrong[0]], got[wrong[0]], brute_extract(pages[wrong[0]]))
    named = [k for k, p in enumerate(pages) if "<article>" in p or "<main>" in p]
    monkeypatch.setattr(html_text, "_clustered", lambda lines: ([True] * len(lines),) * 2)
    changed = sum(html_text.extract(pages[k]) != got[k] for k in named)
    assert changed >= len(named) / 10  # the clusters decide on pages with article or main too
