"""Labelled pages that the extraction model learns from.

Written for this purpose and small in number. ``data-main`` marks an element whose text is the article,
``data-rest`` one inside it whose text is not. ``{n}`` stands for n words of running text and
``{n!}`` for n words without punctuation, as in menus and labels. The marks are not features.
"""

from __future__ import annotations

import re

_WORDS = "stone river morning the of a walked under light house and letter never to window in small paper was green".split()

_MANY = "".join(f"<p>{{{count}}}</p>" for count in (40, 3, 1, 25, 60, 2, 8, 1, 33, 5) * 4)
_REPLIES = "".join(f'<div class="comment"><p>{{{count}}}</p></div>' for count in (14, 30, 3, 22) * 6)

LAYOUTS = [
    f'<html><body><nav><ul><li><a href="/">{{1!}}</a></li></ul></nav><article data-main><h1>{{5!}}</h1>{_MANY}</article><section class="comments">{_REPLIES}</section><footer>{{9}}</footer></body></html>',
    f'<html><body><div class="menu"><a href="/">{{1!}}</a></div><div class="content" data-main><h1>{{5!}}</h1>{_MANY}</div><div class="sidebar">{_MANY}</div><div class="footer">{{9}}</div></body></html>',
    '<html><head><title>{6!}</title></head><body><nav><ul><li><a href="/">{1!}</a></li><li><a href="/b">{2!}</a></li><li><a href="/c">{1!}</a></li></ul></nav>'
    '<article data-main><h1>{7!}</h1><p>{40}</p><p>{75}</p><p>{12}</p><p>{4}</p></article><footer>&copy; {3!} &middot; {8}</footer></body></html>',
    '<html><body><header><a href="/">{2!}</a><p>{9}</p></header><main data-main><h2>{5!}</h2><p>{60}</p><ul><li>{12}</li><li>{9}</li></ul><blockquote>{20}</blockquote></main>'
    '<aside><h3>{2!}</h3><p>{15}</p><ul><li><a href="/r">{6!}</a></li><li><a href="/s">{5!}</a></li></ul></aside><footer><p>{12}</p></footer></body></html>',
    '<html><body><div id="menu"><a href="/1">{1!}</a> <a href="/2">{1!}</a> <a href="/3">{2!}</a></div><div class="ad">{9}</div>'
    '<div class="content" data-main><h1>{6!}</h1><p>{3}</p><p>{55}</p><p>{1}</p><p>{35}</p></div><div class="footer">{10!}</div></body></html>',
    '<html><body><div class="cookie-notice"><p>{18}</p><button>{1!}</button></div><div class="post-body" data-main><p>{80}</p><pre>{15!}</pre><p>{22}</p></div>'
    '<section class="comments"><h3>{1!}</h3><div class="comment"><p>{25}</p></div><div class="comment"><p>{40}</p></div></section></body></html>',
    '<html><body><div class="sidebar"><div class="widget"><h4>{2!}</h4><ul><li><a href="/x">{4!}</a></li><li><a href="/y">{3!}</a></li></ul></div></div>'
    '<div id="article" data-main><h1>{8!}</h1><div><p>{50}</p><div class="ad" data-rest>{14}</div><p>{30}</p></div></div>'
    '<form action="/s"><label>{2!}</label><input name="q"><p>{6}</p></form></body></html>',
    '<html><body><div role="navigation" class="breadcrumb"><a href="/">{1!}</a> &gt; <a href="/t">{1!}</a></div><article data-main><h1>{5!}</h1><p>{2}</p>'
    '<aside class="related" data-rest><p>{10}</p><a href="/z">{6!}</a></aside><p>{65}</p><table><tr><td>{3!}</td><td>{2!}</td></tr></table><p>{28}</p>'
    '<form class="newsletter" data-rest><p>{11}</p><label>{1!}</label></form></article><footer class="site-footer"><nav><a href="/a">{1!}</a></nav><p>{14}</p></footer></body></html>',
    '<html><body><div class="banner promo">{12}</div><div class="notice">{20}</div><article class="entry" data-main><header><h1>{6!}</h1></header><p>{90}</p><h2>{3!}</h2><p>{45}</p>'
    '<div class="share" data-rest><a href="/f">{1!}</a> <a href="/g">{1!}</a></div><section id="comments" data-rest><p>{30}</p><p>{18}</p></section></article></body></html>',
    '<html><body><header class="site-header"><h1>{2!}</h1><nav><ul><li><a href="/">{1!}</a></li></ul></nav></header><section class="story" data-main><p>{5}</p><p>{70}</p><p>{8}</p><ol><li>{14}</li><li>{11}</li></ol></section>'
    '<div id="sidebar"><p>{16}</p></div><div class="popup modal"><p>{9}</p></div><footer>{22}</footer></body></html>',
    '<html><body><article data-main><h1>{6!}</h1><p>{50}</p><aside data-rest><p>{30}</p><p>{12}</p></aside><p>{40}</p><form data-rest><p>{15}</p><label>{2!}</label><button>{1!}</button></form>'
    '<footer data-rest><p>{12}</p></footer></article><section class="comments"><article class="comment"><p>{35}</p></article><article class="comment"><p>{22}</p></article></section></body></html>',
    '<html><body><header><p>{14}</p></header><div class="main-content" data-main><p>{60}</p><div class="advert" data-rest><p>{30}</p></div><p>{25}</p><aside class="sidebar" data-rest><p>{45}</p></aside>'
    '<div class="notice" data-rest><p>{25}</p></div><p>{33}</p></div><aside class="widget"><p>{40}</p></aside><form><fieldset><p>{20}</p></fieldset></form></body></html>',
    '<html><body><div class="header"><p>{11}</p></div><div class="text" data-main><div><p>{30}</p><p>{45}</p></div><div><h3>{4!}</h3><p>{50}</p><figure><figcaption>{8}</figcaption></figure></div></div>'
    '<div class="sidebar"><p>{35}</p></div><div class="replies"><div class="reply"><p>{28}</p></div></div><div class="footer"><p>{25}</p></div></body></html>',
    '<html><body><section data-main><h1>{5!}</h1><p>{44}</p><h3>{3!}</h3><p>{52}</p><h4>{2!}</h4><dl><dt>{2!}</dt><dd>{12}</dd></dl></section><aside><p>{28}</p></aside><form><p>{24}</p></form><footer><p>{36}</p></footer></body></html>',
    '<html><body><header><p>{6}</p></header><section data-main><h1>{6!}</h1><p>{3}</p><p>{70}</p><p>{33}</p></section><section class="related"><p>{20}</p></section><footer><p>{9}</p></footer></body></html>',
    '<html><body><main><section data-main><header><h1>{4!}</h1></header><p>{58}</p><p>{27}</p></section><section class="comments"><p>{31}</p></section></main><footer>{14}</footer></body></html>',
    '<html><body><nav><a href="/">{1!}</a></nav><div class="sponsor">{15}</div><article data-main><p>{2!}</p><p>{3}</p></article><footer>{6}</footer></body></html>',
    '<html><body><nav class="top"><ul><li><a href="/">{2!}</a></li><li><a href="/n">{3!}</a></li></ul></nav><div class="ad">{30}</div><article data-main><h1>{9!}</h1><p>{20}</p><p>{120}</p></article>'
    '<div class="comments"><p>{60}</p><p>{35}</p></div><footer>{18}</footer></body></html>',
]


def _fill(match: re.Match, scale: float) -> str:
    plain = bool(match[2])
    count = int(match[1]) if plain else max(1, round(int(match[1]) * scale))
    words = [_WORDS[(7 * count + 3 * place + place * place) % len(_WORDS)] for place in range(count)]
    return " ".join(words) if plain else " ".join(word + ("," if place % 9 == 8 else "") for place, word in enumerate(words)).capitalize() + "."


def pages() -> list[str]:
    """Every layout with short, medium and long running text."""
    return [re.sub(r"\{(\d+)(!?)\}", lambda match: _fill(match, scale), layout) for layout in LAYOUTS for scale in (0.3, 1.0, 3.0)]
