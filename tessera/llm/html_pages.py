"""Labelled pages that the weights of html.py are learned from, made by a rule: many layouts, with and without names that tell.

The main text's region lies between the first <?content?> and the last <?rest?>; what lies between a <?rest?> and the next <?content?> is no text of it.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

PAGES, SEED = 240, 7
_SYLLABLES = "ba be bo da de di fa ga ge ha he ka ke la le li lo ma me mi na ne no pa pe ra re ro sa se si ta te ti to va ve wa za zo".split()
CONTENT, REST = "<?content?>", "<?rest?>"


def _words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(n))


def _sentences(r: random.Random, n: int) -> str:
    return " ".join(_words(r, r.choice((2, 6, 9, 14, 20, 28))).capitalize() + r.choice(".....!?") for _ in range(n))


def _links(r: random.Random, n: int, mark: str) -> str:
    return "".join(f'<{mark}><a href="/{i}">{_words(r, r.randint(1, 3))}</a></{mark}>' for i in range(n))


def _menu(r: random.Random) -> str:
    items = _links(r, r.randint(3, 12), "li")
    return r.choice((f"<nav><ul>{items}</ul></nav>", f'<div class="{r.choice(("menu", "navbar", "main-nav", "breadcrumbs"))}"><ul>{items}</ul></div>', f"<ul>{items}</ul>", f"<div>{_links(r, 6, 'span')}</div>"))


def _head(r: random.Random) -> str:
    inner = f'<a href="/">{_words(r, 2)}</a> {_words(r, r.randint(2, 6))}'
    return r.choice((f"<header>{inner}</header>", f'<div id="header">{inner}</div>', f'<div class="site-header"><h1>{_words(r, 2)}</h1>{inner}</div>', ""))


def _foot(r: random.Random) -> str:
    inner = f"&copy; {_words(r, r.randint(2, 9))}. {_links(r, r.randint(0, 4), 'span')}"
    return r.choice((f"<footer><p>{inner}</p></footer>", f"<footer>{inner}</footer>", f'<div class="footer">{inner}</div>', f'<div id="copyright">{inner}</div>'))


def _aside(r: random.Random) -> str:
    """What lies beside or inside an article and is none of its text."""
    return r.choice(
        (
            f'<div class="{r.choice(("ad", "ads", "advert", "sponsored"))}">{_words(r, r.randint(2, 25))}</div>',
            f"<aside>{'<p>' * r.randint(0, 1)}{_sentences(r, r.randint(1, 3))}</aside>",
            f'<div class="{r.choice(("related", "sidebar", "share", "widget"))}"><h3>{_words(r, 2)}</h3><ul>{_links(r, r.randint(2, 8), "li")}</ul></div>',
            f'<form action="/s"><label>{_words(r, 2)}</label><input name="q"><p>{_words(r, 4)}</p><button>{_words(r, 1)}</button></form>',
            f'<div class="{r.choice(("newsletter", "cookie-notice", "popup"))}"><p>{_sentences(r, r.randint(1, 3))}</p></div>',
        )
    )


def _comments(r: random.Random) -> str:
    inner = "".join(r.choice(("<div class='comment'><p>{}</p></div>", "<article class='comment'><p>{}</p></article>", "<p>{}</p>")).format(_sentences(r, r.randint(1, 6))) for _ in range(r.randint(1, 6)))
    return r.choice((f'<section class="comments"><h2>{_words(r, 2)}</h2>{inner}</section>', f'<div id="comments">{inner}</div>', f'<ol class="commentlist">{inner}</ol>'))


def _body(r: random.Random) -> str:
    """Blocks of the text, with now and then something that is none of it."""
    out = [r.choice(("<h1>{}</h1>", "<h2>{}</h2>", "<header><h1>{}</h1></header>")).format(_words(r, r.randint(1, 9)))]
    for _ in range(r.choice((1, 2, 3, 5, 8, 13, 25))):
        n = r.choice((1, 1, 2, 3, 5, 9))
        text = _sentences(r, n)
        if r.random() < 0.15:
            text += f' <a href="/w">{_words(r, r.randint(1, 5))}</a> {_sentences(r, 1)}'
        kind = r.choices(("p", "bare", "list", "quote", "heading", "pre", "table", "open", "bold"), (12, 2, 2, 1, 2, 1, 1, 2, 1))[0]
        if kind == "list":
            out.append("<ul>" + "".join(f"<li>{_words(r, r.choice((1, 3, 8, 15)))}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
        elif kind == "table":
            out.append("<table>" + "".join(f"<tr><td>{_words(r, 2)}</td><td>{_words(r, 3)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
        else:
            frame = {"p": "<p>{}</p>", "bare": "<div>{}</div>", "quote": "<blockquote><p>{}</p></blockquote>", "heading": "<h2>{}</h2>", "pre": "<pre>{}</pre>", "open": "<p>{}", "bold": "<p><b>{}</b></p>"}
            out.append(frame[kind].format(_words(r, r.randint(1, 6)) if kind == "heading" else text))
        if r.random() < 0.12:
            out.append(REST + r.choice((_aside, _aside, _aside, _comments))(r) + CONTENT)
    return "".join(out)


def labelled_pages(n: int = PAGES, seed: int = SEED) -> Iterator[str]:
    r = random.Random(seed)
    for _ in range(n):
        body = CONTENT + _body(r) + REST
        around = r.random()
        if around < 0.35:
            body = f"<article>{body}</article>"
        elif around < 0.5:
            body = f"<main>{body}{r.choice(('', _comments(r)))}</main>"
        elif around < 0.6:
            body = f"<main><article>{body}</article>{r.choice(('', _aside(r), _comments(r)))}</main>"
        elif around < 0.8:
            body = f'<div id="{r.choice(("content", "post", "x1", "text"))}">{body}</div>'
        elif around < 0.9:
            body = f"<table><tr><td>{_links(r, 5, 'span')}</td><td>{body}</td></tr></table>"
        before, after = [_menu(r), _head(r)], [_foot(r)]
        r.shuffle(before)
        for _ in range(r.randint(0, 2)):
            r.choice((before, after)).append(_aside(r))
        if r.random() < 0.3:
            after.insert(0, _comments(r))
        if r.random() < 0.2:
            after.append(_menu(r))
        yield f"<html><head><title>{_words(r, 4)}</title><style>p{{}}</style><script>var a=1;</script></head><body>{''.join(before)}{body}{''.join(after)}</body></html>"
