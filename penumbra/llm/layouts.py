"""Labelled pages: layouts of several families with known content, made from a seed.

Families differ in what tells content from the rest: classes and sectioning elements (`classed`), the same in other
languages (`foreign`), tables as layout (`tables`), divs without classes where only links, lengths and places tell
(`bare`), and headings outside the article with nested threads of comments below (`threads`).
"""

from __future__ import annotations

import html
import random

SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi zo an el in or un ark est ing ond urt al eth".split()


def _words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n))


def _sentence(r: random.Random, least: int = 4, most: int = 24) -> str:
    return _words(r, r.randint(least, most)).capitalize() + r.choice([".", ".", ".", "?", "!"])


def _paragraph(r: random.Random) -> str:
    return " ".join(_sentence(r) for _ in range(r.choice([1, 1, 2, 3, 5, 8])))


FAMILIES = ("classed", "foreign", "tables", "bare", "threads")
#: Class names by part of a page, in the families' languages.
NAMES = {
    "classed": {
        "menu": ["nav", "navbar", "main-menu", "menu", "breadcrumbs", "navigation"], "top": ["header", "site-header", "masthead", "topbar"], "bottom": ["footer", "site-footer", "copyright", "colophon"],
        "side": ["sidebar", "related", "widget", "side", "recommended-posts", "trending", "tags"], "advert": ["ad", "ads", "advert", "ad-slot", "sponsored", "promo", "advertisement"],
        "note": ["cookie-notice", "notice", "newsletter", "consent", "alert", "cookie-banner", "subscribe", "gdpr", "popup"], "talk": ["comments", "comment-list", "disqus", "replies", "reader-comments"],
        "share": ["share", "social", "share-buttons", "follow"], "main": ["content", "main-content", "post-body", "article", "entry-content", "story"],
    },
    "foreign": {
        "menu": ["menue", "navigation", "menu-principal", "navegacion", "hauptmenue"], "top": ["kopfzeile", "entete", "cabecera", "kopf"], "bottom": ["fusszeile", "pied-de-page", "pie", "impressum"],
        "side": ["seitenleiste", "barre-laterale", "barra-lateral", "verwandt", "relacionados"], "advert": ["werbung", "anzeige", "publicite", "anuncio", "publicidad"],
        "note": ["hinweis", "cookie-hinweis", "avis", "aviso", "bulletin", "boletin"], "talk": ["kommentare", "commentaires", "comentarios", "leserbriefe"],
        "share": ["teilen", "partager", "compartir"], "main": ["inhalt", "hauptinhalt", "contenu", "contenido", "artikel", "beitrag", "articulo"],
    },
}


def page(seed: int, family: str = "classed") -> tuple[str, set[str]]:
    """(html, its content blocks)."""
    r = random.Random(f"{family} {seed}")
    names = NAMES["foreign" if family == "foreign" else "classed"]
    content: set[str] = set()

    def good(text: str) -> str:
        content.add(text)
        return html.escape(text)

    def links(n: int) -> str:
        kind = r.choice(["ul", "ul", "div", "p"])
        item = (lambda t: f'<li><a href="/x">{t}</a></li>') if kind == "ul" else (lambda t: f'<a href="/x">{t}</a> ')
        return f"<{kind}>" + "".join(item(_words(r, r.randint(1, 3))) for _ in range(n)) + f"</{kind}>"

    def box(tags: list[str], classes: list[str], inside: str) -> str:
        tag = r.choice(tags)
        if family in ("bare", "tables"):
            return f"<div>{inside}</div>"
        mark = f' {r.choice(["class", "class", "id"])}="{r.choice(classes)}"' if tag in ("div", "section", "ul", "p") or r.random() < 0.4 else ""
        return f"<{tag}{mark}>{inside}</{tag}>"

    def menu() -> str:
        return box(["nav", "nav", "div", "ul"], names["menu"], links(r.randint(3, 9)))

    def top() -> str:
        return box(["header", "header", "div"], names["top"], r.choice([f"<h1>{_words(r, 3)}</h1>", f"<p>{_sentence(r)}</p>", f"<div>{_words(r, 2)}</div>"]) + (menu() if r.random() < 0.5 else ""))

    def bottom() -> str:
        return box(["footer", "footer", "div"], names["bottom"], r.choice([f"{_words(r, 2)} {_sentence(r)}", f"<p>{_sentence(r)}</p>" + links(4), links(6), f"<p>{_paragraph(r)}</p>"]))

    def side() -> str:
        return box(["aside", "aside", "div", "section"], names["side"], f"<h3>{_words(r, 2)}</h3>" + r.choice([links(5), f"<p>{_paragraph(r)}</p>", f"<p>{_sentence(r)}</p>" + links(3)]))

    def advert() -> str:
        return box(["div", "div", "aside", "section", "p"], names["advert"], r.choice([_sentence(r), f"<p>{_paragraph(r)}</p>", f'<a href="/b">{_sentence(r)}</a>']))

    def note() -> str:
        return box(["div", "section", "div", "p"], names["note"], r.choice([f"<p>{_paragraph(r)}</p>", _sentence(r), f"<p>{_sentence(r)}</p><button>{_words(r, 1)}</button>"]))

    def form() -> str:
        return f"<form{r.choice(['', ' class=search', ' id=login'])}><p>{_sentence(r)}</p><label>{_words(r, 2)}</label><input name=q><select><option>{_words(r, 1)}<option>{_words(r, 1)}</select><button>{_words(r, 1)}</button></form>"

    def talk() -> str:
        each = r.choice([lambda: f'<div class="comment"><b>{_words(r, 1)}</b><p>{_paragraph(r)}</p></div>', lambda: f"<li><p>{_paragraph(r)}</p></li>", lambda: f"<article class=comment><p>{_paragraph(r)}</p></article>"])
        inside = "".join(each() for _ in range(r.randint(1, 5)))
        return box(["section", "div"], names["talk"], f"<h2>{_words(r, 2)}</h2>" + (f"<ul>{inside}</ul>" if inside.startswith("<li") else inside))

    def share() -> str:
        return box(["div", "ul"], names["share"], links(3))

    def body() -> str:
        out = [f"<h1>{good(_sentence(r, 2, 9)[:-1])}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.choice([1, 2, 3, 4, 6, 10, 18])):
            kind = r.random()
            if kind < 0.1:
                out.append(f"<p>{good(_words(r, r.randint(1, 3)).capitalize() + '.')}</p>")
            elif kind < 0.17:
                out.append(f"<p>{good(_paragraph(r))}</p>")
            elif kind < 0.62:
                out.append(f"<p>{good(_paragraph(r))}" + r.choice(["</p>", "</p>", "</p>", "\n"]))
            elif kind < 0.68:
                one, two = _sentence(r), _sentence(r)
                content.add(f"{one} {two}")
                out.append(f"<p>{one} <strong>{two}</strong></p>")
            elif kind < 0.74:
                one, two, three = _sentence(r), _words(r, 2), _words(r, 4)
                content.add(f"{one} {two} {three}")
                mark = r.choice(["", "", ' class="tags"', ' class=text', ' id=follow'])
                out.append(f'<p>{one} <a href="/y"{mark}>{two}</a> <em{mark}>{three}</em></p>')
            elif kind < 0.8:
                out.append(f"<h2>{good(_words(r, 3))}</h2>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{good(_sentence(r))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote>{good(_sentence(r))}</blockquote>")
            elif kind < 0.93:
                out.append("<table>" + "".join(f"<tr><td>{good(_words(r, 2))}</td><td>{good(_words(r, 3))}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.95:
                out.append(f"<div><p>{good(_paragraph(r))}</p></div>")
            else:
                out.append(r.choice([form, menu] if family in ("bare", "tables") else [advert, share, side, note, form])())
        return "".join(out)

    def thread(depth: int) -> str:
        below = "".join(thread(depth - 1) for _ in range(r.randint(0, 2))) if depth else ""
        return f'<li class="comment depth-{depth}"><div class="vcard"><b>{_words(r, 1)}</b> <a href="#c">{_words(r, 2)}</a></div><p>{_paragraph(r)}</p>' + (f'<ol class="children">{below}</ol>' if below else "") + "</li>"

    def line_of_links() -> str:
        return "<p>" + r.choice([" ", " | ", " "]).join(f"<a href=/{i}>{_words(r, r.randint(1, 2))}</a>" for i in range(r.randint(2, 6))) + "</p>"

    extras = (top, menu, advert, note, form, side)
    after = "".join(f() for f in (share, talk, side, advert, form, note, bottom) if r.random() < 0.4 and not (family in ("bare", "tables") and f in (talk, note, advert)))
    before = "".join(f() for f in extras if r.random() < 0.45 and not (family in ("bare", "tables") and f in (note, advert, side, top)))
    if family == "bare":
        before, after = links(r.randint(4, 9)), links(r.randint(3, 6)) + f"<div>{_words(r, 3)}</div>" if r.random() < 0.7 else ""
        whole = (f"<div>{before}</div>" if r.random() < 0.6 else before) + f"<div>{body()}</div><div>{after}</div>"
    elif family == "tables":
        whole = f'<table width="100%"><tr><td colspan=2>{_words(r, 2)} {links(r.randint(3, 6))}</td></tr><tr><td width=150 valign=top>{links(r.randint(4, 9))}</td><td valign=top>{body()}</td></tr><tr><td colspan=2>{links(r.randint(2, 5))}{_words(r, 2)}</td></tr></table>'
    elif family == "threads":
        title = _sentence(r, 2, 9)[:-1]
        whole = f"<h1>{good(title)}</h1><article><div class={r.choice(names['main'])}>{body()}</div></article>"
        whole = before + whole + f'<div id="comments"><h2>{_words(r, 2)}</h2><ol class="commentlist">{"".join(thread(r.randint(0, 3)) for _ in range(r.randint(1, 4)))}</ol></div>' + after
    else:
        holder = r.choice(["article", "article", "article", "main", f"div class={r.choice(names['main'])}", f'div id="{r.choice(names["main"])}"', f'div class="{r.choice(names["main"])}"', f"section class={r.choice(names['main'])}", "div"])
        tag = holder.split()[0]
        inner = f"<{holder}>{body()}" + (talk() if r.random() < 0.15 else "") + f"</{tag}>"
        whole = before + (f"<main>{inner}</main>" if r.random() < 0.25 else inner) + after
    if r.random() < 0.25:
        whole = line_of_links() + whole
    if r.random() < 0.15:
        whole += line_of_links()
    for _ in range(r.choice([0, 0, 1, 2])):
        whole = f"<div{r.choice(['', ' class=wrapper', ' id=page', ' class=container'])}>{whole}</div>"
    return f'<!DOCTYPE html><html><head><title>{_words(r, 4)}</title></head><body><!-- {_words(r, 2)} -->{whole}' + r.choice(["</body></html>", ""]), content


def pages(n: int, first: int = 0, families: tuple[str, ...] = FAMILIES) -> list[tuple[str, set[str]]]:
    return [page(first + i, families[i % len(families)]) for i in range(n)]
