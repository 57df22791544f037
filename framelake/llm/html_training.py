"""Labelled pages to train the extractor on: layouts of many kinds with the role of each part known."""

from __future__ import annotations

import random

#: Marks that sites give to parts that are no main text, by role, and to main text.
BOILER = {
    "nav": "nav navbar menu navigation breadcrumb breadcrumbs topbar mainmenu tabs pagination pager",
    "header": "header masthead banner logo site top brand",
    "footer": "footer bottom copyright legal colophon site",
    "aside": "sidebar aside related widget trending popular recommended more teaser rail",
    "notice": "cookie consent notice alert gdpr privacy popup modal message paywall",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner",
    "form": "form newsletter subscribe signup search login contact",
    "comments": "comments comment reply respond discussion disqus thread responses",
    "share": "share social follow sharing",
}
MAIN = "article content post entry story main body text page blog single"
LETTERS = "etaoinshrdlucmfwypvbgk"


def _word(rng: random.Random) -> str:
    return "".join(rng.choice(LETTERS) for _ in range(rng.randint(2, 9)))


def _sentence(rng: random.Random, low: int, high: int) -> str:
    words = [_word(rng) for _ in range(rng.randint(low, high))]
    marks = [w + ("," if rng.random() < 0.08 else "") for w in words]
    return " ".join(marks).capitalize() + rng.choice(["."] * 6 + ["!", "?"])


def _paragraph(rng: random.Random) -> str:
    kind = rng.random()
    if kind < 0.2:
        return _sentence(rng, 1, 6)
    if kind < 0.25:
        return " ".join([_word(rng)] * rng.randint(10, 80))
    if kind < 0.3:
        return " | ".join(_word(rng) for _ in range(rng.randint(5, 60)))
    return " ".join(_sentence(rng, 4, 18) for _ in range(rng.randint(1, 6)))


def _mark(rng: random.Random, role: str) -> str:
    if rng.random() < 0.15:
        return ""
    names = (BOILER.get(role) or MAIN).split()
    name = rng.choice(names) + (rng.choice(["", "-" + rng.choice(names), "-box", "-wrap", "-list", "1"]))
    return f' {rng.choice(["class", "class", "id"])}="{name}"'


def _links(rng: random.Random) -> str:
    items = [f'<li><a href="/{_word(rng)}">{" ".join(_word(rng) for _ in range(rng.randint(1, 4)))}</a></li>' for _ in range(rng.randint(2, 8))]
    return f"<ul>{''.join(items)}</ul>"


def _part(rng: random.Random, role: str) -> str:
    tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside"}.get(role, "section" if rng.random() < 0.2 else "div")
    mark = _mark(rng, role)
    if tag != "div" and rng.random() < 0.3:
        tag, mark = "div", mark or f' class="{BOILER[role].split()[0]}"'
    if not mark and tag in ("div", "section"):
        mark = f' class="{BOILER[role].split()[0]}"'
    inside = {
        "nav": lambda: _links(rng),
        "header": lambda: f"<h2>{_sentence(rng, 1, 4)}</h2>" + (f"<p>{_sentence(rng, 3, 8)}</p>" if rng.random() < 0.5 else ""),
        "footer": lambda: (f"&copy; {_word(rng)}.example &middot; " if rng.random() < 0.7 else "") + _sentence(rng, 3, 14) + (_links(rng) if rng.random() < 0.4 else ""),
        "aside": lambda: rng.choice(["", f"<h3>{_sentence(rng, 1, 4)}</h3>"]) + rng.choice([_links(rng), f"<p>{_paragraph(rng)}</p>", _sentence(rng, 2, 9)]),
        "notice": lambda: f"<p>{_sentence(rng, 6, 20)}</p><button>{_word(rng)}</button>",
        "ad": lambda: _sentence(rng, 3, 16) if rng.random() < 0.6 else f"<p>{_paragraph(rng)}</p>",
        "form": lambda: f"<form><label>{_word(rng)}</label><input name=q><button>{_word(rng)}</button><p>{_sentence(rng, 3, 10)}</p></form>",
        "comments": lambda: rng.choice(["", f"<h3>{_sentence(rng, 1, 3)}</h3>"]) + "".join(f'<{t}{c}>{rng.choice(["", f"<b>{_word(rng)}</b>"])}<p>{_paragraph(rng)}</p></{t}>' for t, c in [rng.choice([("div", ' class="comment"'), ("li", ""), ("div", "")])] * rng.randint(1, 5)),
        "share": lambda: _links(rng),
    }[role]()
    return f"<{tag}{mark}>{inside}</{tag}>"


def _article(rng: random.Random) -> str:
    out = [f"<h1>{_sentence(rng, 3, 12)}</h1>"] if rng.random() < 0.8 else []
    for _ in range(rng.randint(1, 14)):
        kind = rng.random()
        if kind < 0.75:
            out.append(f"<p>{_paragraph(rng)}</p>" if rng.random() < 0.85 else f"<p><b>{_paragraph(rng)}<br>")
        elif kind < 0.83:
            out.append(f"<h2>{_sentence(rng, 2, 6)}</h2>")
        elif kind < 0.89:
            out.append(f"<blockquote>{_paragraph(rng)}</blockquote>")
        elif kind < 0.95:
            out.append("<ul>" + "".join(f"<li>{_sentence(rng, 3, 12)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
        else:
            out.append(f'<p>{_sentence(rng, 3, 9)} <a href="/x">{_word(rng)}</a> {_sentence(rng, 3, 9)}</p>')
    return "".join(out)


def labelled_page(rng: random.Random) -> list[tuple[str, bool]]:
    """A page's parts in order, each whole markup of its own, with whether it is main text."""
    main = rng.choice(["article", "main", "div", "div", "section"])
    mark = _mark(rng, "main") if main in ("article", "main") else (_mark(rng, "main") or ' class="content"')
    around = [(_part(rng, r), False) for r in ("notice", "header", "nav", "ad") if rng.random() < {"notice": 0.3, "header": 0.5, "nav": 0.8, "ad": 0.5}[r]]
    after = [(_part(rng, r), False) for r in ("share", "form", "aside", "comments", "ad", "footer") if rng.random() < {"share": 0.2, "form": 0.3, "aside": 0.4, "comments": 0.6, "ad": 0.2, "footer": 0.9}[r]]
    inner = [(_article(rng), True)]
    if rng.random() < 0.4:
        inner += [(_part(rng, rng.choice(["ad", "aside", "aside", "share", "form", "notice", "comments"])), False), (_article(rng), True)]
    opened = [(f"<{main}{mark}>", False), *inner, (f"</{main}>", False)]
    return [("<html><body>", False), *around, *opened, *after, ("</body></html>", False)]


def labelled_pages(n: int, seed: int = 5) -> list[list[tuple[str, bool]]]:
    rng = random.Random(seed)
    return [labelled_page(rng) for _ in range(n)]
