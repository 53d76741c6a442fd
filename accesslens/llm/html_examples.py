"""Labelled pages: layouts by hand, with `data-keep` on the main text, filled with invented words.

`{n}` stands for n words in sentences, `{n:link}` for n linked words, `{n:words}` for n
words without a sentence's end.
"""

from __future__ import annotations

import random
import re

_LAYOUTS = [
    # news article with every kind of frame around it
    """<body><header><div class="logo">{2:words}</div><nav><ul><li>{1:link}</li><li>{1:link}</li><li>{2:link}</li></ul></nav></header>
    <div class="ad">{8}</div><article data-keep><h1>{8:words}</h1><p>{30}</p><p>{60}</p><h2>{4:words}</h2><p>{4}</p><p>{90}</p></article>
    <aside class="sidebar"><h3>{2:words}</h3><ul><li>{5:link}</li><li>{6:link}</li></ul></aside>
    <section id="comments"><h3>{2:words}</h3><div class="comment"><p>{25}</p></div><div class="comment"><p>{40}</p></div></section>
    <footer>&copy; {3:words} · {6}</footer></body>""",
    # bare layout with an advert and a short article
    """<body><nav><ul><li>{1:link}</li><li>{1:link}</li></ul></nav><div class="ad">{12}</div>
    <article data-keep><h1>{6:words}</h1><p>{12}</p><p>{3}</p></article><footer>&copy; {2:words} {9}</footer></body>""",
    """<body><nav><ul><li>{1:link}</li></ul></nav><div class="ad">{5}</div>
    <article data-keep><h1>{9:words}</h1><p>{120}</p><p>{2}</p><p>{1}</p><p>{40}</p><ul><li>{3:words}</li><li>{7}</li></ul></article>
    <footer>{12}</footer></body>""",
    # blog of plain boxes
    """<body><div id="header"><h1>{3:words}</h1><p>{6:words}</p></div><div id="menu"><a href=x>{1:words}</a> <a href=y>{1:words}</a></div>
    <div id="content"><div class="post" data-keep><h2>{6:words}</h2><p>{45}</p><blockquote><p>{20}</p></blockquote><p>{35}</p><p>{5}</p></div>
    <div class="share">{4:link}</div><div id="respond"><form><p>{5:words}</p><label>{1:words}</label><button>{1:words}</button></form></div></div>
    <div id="sidebar"><div class="widget"><h3>{2:words}</h3><p>{20}</p></div></div><div id="footer"><p>{10}</p></div></body>""",
    # main element, consent notice, breadcrumb
    """<body><div class="cookie-notice" role="dialog"><p>{22}</p><button>{1:words}</button></div><div class="breadcrumb">{1:link} › {2:link}</div>
    <main data-keep><h1>{5:words}</h1><p>{28}</p><ul><li>{8}</li><li>{4:words}</li><li>{12}</li></ul><p>{50}</p></main>
    <div class="newsletter"><h4>{3:words}</h4><p>{15}</p><form><input><button>{2:words}</button></form></div><footer><p>{7:words}</p></footer></body>""",
    # text straight in a box, tables, quotes
    """<body><table class="navbar"><tr><td>{1:link}</td><td>{1:link}</td></tr></table><div class="story-body" data-keep>{40}<p>{30}</p>
    <table><tr><th>{2:words}</th><th>{1:words}</th></tr><tr><td>{3:words}</td><td>{4}</td></tr></table><pre>{14}</pre><h3>{3:words}</h3>{25}</div>
    <div class="related"><h3>{2:words}</h3><ul><li>{7:link}</li><li>{8:link}</li></ul></div><div class="copyright">{6}</div></body>""",
    # article with parts inside that don't belong to it
    """<body><header class="masthead"><p>{4:words}</p></header><main><article><header><h1 data-keep>{7:words}</h1><p class="byline">by {2:words}</p></header>
    <div class="entry-content"><p data-keep>{33}</p><div class="advertisement"><p>{14}</p></div><p data-keep>{48}</p>
    <figure data-keep><figcaption>{9}</figcaption></figure><p data-keep>{21}</p></div><footer><ul class="tags"><li>{1:link}</li></ul></footer></article>
    <section class="comments"><article class="comment"><p>{30}</p></article><article class="comment"><p>{18}</p></article></section></main>
    <aside><p>{16}</p></aside><footer><nav><ul><li>{1:link}</li></ul></nav><p>© {5:words}</p></footer></body>""",
    # no names at all
    """<body><div><a href=x>{1:words}</a> | <a href=y>{1:words}</a> | <a href=z>{2:words}</a></div><div data-keep><h1>{6:words}</h1><p>{55}</p><p>{40}</p>
    <ol><li>{10}</li><li>{15}</li></ol><p>{6}</p></div><div><ul><li>{3:link}</li><li>{4:link}</li></ul></div><div>© {4:words}</div></body>""",
    # sections of a long read, alert on top
    """<body><div class="alert"><p>{12}</p></div><nav class="topbar">{3:link}</nav><div role="main" data-keep><section><h2>{4:words}</h2><p>{70}</p></section>
    <section><h2>{3:words}</h2><p>{65}</p><p>{2:words}</p></section><dl><dt>{2:words}</dt><dd>{9}</dd></dl></div>
    <div class="popular widget"><ol><li>{5:link}</li><li>{5:link}</li></ol></div><form class="search"><p>{3:words}</p></form>
    <div class="comment-list"><ol><li class="comment"><p>{35}</p></li><li class="comment"><p>{22}</p></li></ol></div><footer class="footer"><p>{14}</p></footer></body>""",
    # nothing to keep
    """<body><nav><ul><li>{2:link}</li><li>{1:link}</li></ul></nav><form><p>{6}</p><button>{1:words}</button></form><footer><p>{9}</p></footer></body>""",
]


def labelled_pages(per_layout: int = 24, seed: int = 7) -> list[str]:
    """Each layout, filled anew every time."""
    rng = random.Random(seed)

    def word() -> str:
        return "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))

    def fill(match: re.Match) -> str:
        n, how = max(1, round(int(match[1]) * rng.uniform(0.4, 2.5))), match[2]
        words = [word() for _ in range(n)]
        if how == ":link":
            return f'<a href="#">{" ".join(words)}</a>'
        if how == ":words":
            return " ".join(words)
        for k in range(rng.randint(6, 18), n, rng.randint(6, 18)):
            words[k - 1] += "."
        return " ".join(words) + rng.choice("....?!")

    return [re.sub(r"\{(\d+)(:\w+)?\}", fill, layout) for layout in _LAYOUTS for _ in range(per_layout)]
