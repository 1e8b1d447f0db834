"""Labelled pages the content model is trained on, built from skeletons with a fixed seed.

In a skeleton `+` behind a tag name marks content and `-` marks what is not; both hold for the
elements inside until marked again. {k} stands for k words, {s} for a sentence, {p} for a paragraph.
"""

from __future__ import annotations

import random
import re

NAVS = [
    "<nav-><ul><li><a>{1}</a></li><li><a>{2}</a></li><li><a>{1}</a></li><li><a>{1}</a></li></ul></nav>",
    '<div- class="menu"><a>{1}</a> <a>{1}</a> <a>{2}</a></div>',
    '<header-><div class="logo">{2}</div><nav><a>{1}</a><a>{1}</a><a>{1}</a></nav></header>',
    '<header- class="site-header"><h1>{2}</h1><p>{5}</p><ul id="nav"><li><a>{1}</a></li><li><a>{1}</a></li></ul></header>',
    '<div- id="breadcrumbs"><a>{1}</a> &gt; <a>{1}</a> &gt; {2}</div>',
]
NOTICES = [
    '<div- class="ad">{s}</div>', '<div- class="advert"><a>{4}</a></div>', '<aside- class="promo"><p>{s}</p></aside>',
    '<div- id="cookie-notice"><p>{s}</p><button>{1}</button></div>', '<div- class="notice">{s}</div>',
    '<section- class="newsletter"><h2>{3}</h2><form><label>{2}</label><input><button>{1}</button></form></section>',
    '<form- action="/search"><input name="q"><button>{1}</button></form>', '<div- class="banner sponsor"><p>{s}</p></div>',
    '<div- role="alert">{s}</div>', '<div- class="share social"><a>{1}</a><a>{1}</a><a>{1}</a></div>',
]
SIDES = [
    '<aside-><h3>{2}</h3><ul><li><a>{4}</a></li><li><a>{5}</a></li><li><a>{3}</a></li></ul></aside>',
    '<div- class="sidebar"><h3>{2}</h3><p>{s}</p><a>{3}</a></div>', '<section- class="related"><h2>{2}</h2><ul><li><a>{6}</a></li><li><a>{7}</a></li></ul></section>',
    '<div- class="widget tags"><a>{1}</a> <a>{1}</a></div>', '<aside-><p>{p}</p></aside>',
]
FEET = [
    "<footer->&copy; {3} &middot; {s}</footer>", '<div- id="footer"><p>&copy; {4}</p><a>{1}</a><a>{1}</a></div>',
    "<footer-><nav><a>{1}</a><a>{2}</a></nav><p>{s}</p></footer>",
]
COMMENTS = [
    '<section- class="comments"><h2>{1}</h2><div class="comment"><p>{s}</p></div><div class="comment"><p>{p}</p></div></section>',
    '<div- id="comments"><h3>{2}</h3><ol><li><b>{1}</b><p>{p}</p></li><li><b>{1}</b><p>{s}</p></li></ol></div>',
    '<ul- class="comment-list"><li class="comment"><p>{p}</p></li></ul>', '<div- class="replies"><p>{s}</p><p>{p}</p></div>',
]
BODIES = [
    "<p>{p}</p><p>{p}</p>", "<p>{p}<br><p>{p}</p><p>{s}</p>", "<p>{p}</p><h2>{4}</h2><p>{p}</p><ul><li>{s}</li><li>{s}</li></ul><p>{p}</p>",
    "<p>{s}</p>", "<p>{3}.</p>", "<p>{1}</p><p>{p}</p>", "<p><b>{1}<br><p>{p}</p>", "<p>{2}</p>", "<p><b>{1}</b><p>{1}.</p><p>{p}</p>", "<h2>{3}</h2><p>{p}</p><blockquote><p>{s}</p></blockquote><p>{p}</p>", "<p><b>{s}<br><p>{p}</p><p>{p}</p>",
    "<p>{p}</p><table><tr><th>{1}</th><td>{2}</td></tr><tr><th>{1}</th><td>{2}</td></tr></table><p>{p}</p>", "{p}<br><br>{p}",
    "<p>{p} <a>{2}</a> {s}</p><pre>{5}</pre><ol><li>{4}</li><li><a>{3}</a> {s}</li></ol>", "<figure>{2}<figcaption>{s}</figcaption></figure><p>{p}</p>",
]
HOMES = [
    "<article+><h1>{t}</h1>@</article>", "<main+><h1>{t}</h1>@</main>", "<main><article+><h1>{t}</h1>@</article>#</main>",
    '<div+ class="content"><h1>{t}</h1>@</div>', '<div id="wrapper"><div+ class="post-body"><h2>{t}</h2>@</div>#</div>',
    "<article+><header><h1>{t}</h1></header>@#</article>", '<section+ id="main-content">@</section>', "<div class=\"page\"><article+>@</article>#</div>",
    '<div+ class="article"><div class="entry">@</div></div>', "<article+><h1>{t}</h1>@#@</article>",
]
VOCABULARY = 800
PAGES = 160


def pages(count: int = PAGES, seed: int = 11) -> list[str]:
    """HTML pages whose elements carry data-label="1" or "0" where a label starts."""
    rng = random.Random(seed)
    syllables = [a + b for a in "bcdfglmnprstv" for b in "aeiou"]
    vocabulary = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(VOCABULARY)]

    def sentence() -> str:
        return " ".join(rng.choices(vocabulary, k=rng.randint(4, 18))).capitalize() + "."

    def fill(m: re.Match) -> str:
        kind = m[1]
        if kind == "s":
            return sentence()
        if kind == "p":
            return " ".join(sentence() for _ in range(rng.randint(1, 8)))
        if kind == "t":
            return " ".join(rng.choices(vocabulary, k=rng.randint(1, 9))).capitalize()
        return " ".join(rng.choices(vocabulary, k=int(kind))).capitalize()

    out = []
    for _ in range(count):
        some = lambda pool, most: "".join(rng.choices(pool, k=rng.randint(0, most)))
        home = rng.choice(HOMES)
        while "@" in home:
            home = home.replace("@", rng.choice(BODIES), 1)
        home = home.replace("#", rng.choice([some(NOTICES, 2), some(COMMENTS, 1), some(SIDES, 1)]))
        html = (f"<body->{some(NAVS, 2)}{some(NOTICES, 2)}{some(SIDES, 1)}{home}{some(COMMENTS, 1)}{some(SIDES, 1)}{some(FEET, 1)}</body>")
        html = re.sub(r"\{(\w+)\}", fill, html)
        html = re.sub(r"<(\w+)([+-])", lambda m: f'<{m[1]} data-label="{int(m[2] == "+")}"', html)
        out.append(html)
    return out
