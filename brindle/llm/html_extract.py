"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A tolerant scan of the markup gives leaf blocks: stretches of text between tags that break lines, each with the tags
and the class, id and role names that it stands in. Features of the ancestors and of the text feed a chain of
two labels, main and other, trained on labelled pages (which `labelled_pages` makes: layouts of many kinds with known
main blocks) by gradient ascent on the likelihood and decoded by Viterbi.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import batched, let_go, table, tidy

#: Fixed values of HTML: elements whose content is no text, that never hold anything, and that are inside a line.
RAW = frozenset("script style noscript template iframe object svg math canvas textarea select title head".split())
#: Of these, those that end at once with a slash, and those whose content is read as markup where nothing closes them.
FOREIGN = frozenset("svg math object canvas iframe".split())
OPEN = frozenset("svg math object canvas select noscript template iframe textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?:[!?][^>]*(?:>|\Z))|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(>|\Z)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role|itemprop|aria-label|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[a-z]+")

Block = tuple[tuple[str, ...], str, int]  # the names of its ancestors, its text, the characters of it inside links


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page in order: text with character references decoded and white space as one space each."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    path: tuple[str, ...] = ()
    out: list[Block] = []
    parts: list[str] = []
    unclosed: set[str] = set()
    linked, links, at, n = 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip() if parts else ""
        if text:
            out.append((path, text, min(linked, len(text))))
        parts.clear()
        linked = 0

    while at < n:
        m = _TAG.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            parts.append(text)
            linked += len(text) if links else 0
        if not m:
            break
        at = m.end()
        name = (m[2] or m[6] or "").lower()
        if not name or not (m[4] or m[8]):  # a comment, a declaration, or a tag that the page's end cuts off
            continue
        closing = bool(m[1] or m[5])
        alone = (m[3] or m[7] or "").endswith("/")  # <svg ... /> has no content
        if name in RAW and not closing:
            if name == "head" or alone and name in FOREIGN:
                continue
            end = None if name in unclosed else re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if not end and name in OPEN:
                unclosed.add(name)  # never closed, here and further on: what follows is read as markup
                continue
            flush()
            at = end.end() if end else n
            continue
        if name == "head":
            continue
        if name in INLINE:
            links += (name == "a") * (-1 if closing and links else 0 if closing else 1)
            if name in ("br", "img"):
                parts.append(" ")
            continue
        flush()
        links = 0
        if closing:
            if any(t == name for t, _ in stack):
                while stack.pop()[0] != name:
                    pass
        elif name not in VOID and not alone:
            if name in ENDS_P and stack and stack[-1][0] == "p" or name in ("li", "tr", "td", "th", "dt", "dd", "option") and stack and stack[-1][0] == name:
                stack.pop()
            names = " ".join(a or b or c or k for k, a, b, c in ((x[0].split("=")[0].strip().lower(), x[1], x[2], x[3]) for x in _NAMES.finditer(m[3] or m[7] or "")))
            stack.append((name, tuple(_WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", names).lower())) if names else ()))
        else:
            continue
        path = tuple(t for t, _ in stack) + tuple("." + w for _, ws in stack for w in ws)
    flush()
    return out


#: Hash buckets of features.
FEATURES = 1 << 14


@lru_cache(maxsize=5_000)
def _path_features(path: tuple[str, ...]) -> tuple[str, ...]:
    tags = [p for p in path if p[0] != "."]
    names = sorted({p for p in path if p[0] == "."})
    return tuple(sorted({"in " + t for t in tags})) + tuple("name " + w for w in names) + ("leaf " + (tags[-1] if tags else "-"), "pair " + "/".join(tags[-2:]), f"depth {min(len(tags), 6)}")


def features(blocks: list[Block]) -> list[list[int]]:
    """Numbers of each block's features, from the ancestors' tags and names and from its text."""
    out = []
    for i, (path, text, linked) in enumerate(blocks):
        n = len(text)
        words = text.count(" ") + 1
        share = linked / n
        f = [*_path_features(path), f"words {min(words.bit_length(), 7)}", f"links {0 if not linked else 1 + int(share > 0.3) + int(share > 0.8)}"]
        f.append(f"stops {min(sum(map(text.count, '.!?')), 3)}")
        f.append(f"end {'.' if text[-1] in '.!?:' else '-'}")
        f.append("bar" if "|" in text or "·" in text or "»" in text else "no bar")
        if "©" in text or text.lower().startswith("(c)"):
            f.append("copyright")
        if i == 0 or i == len(blocks) - 1:
            f.append("first" if i == 0 else "last")
        out.append([zlib.crc32(x.encode()) % FEATURES for x in f])
    return out


class Chain:
    """The field: weights of features for the label main, and of neighbouring labels. Label 0 is other, 1 is main."""

    def __init__(self) -> None:
        self.weight, self.bias, self.move = np.zeros(FEATURES), 0.0, np.zeros((2, 2))

    def scores(self, blocks: list[Block]) -> list[float]:
        w = self.weight
        return [self.bias + sum([w[k] for k in f]) for f in features(blocks)]

    def decode(self, blocks: list[Block]) -> list[int]:
        """The likeliest labels (Viterbi)."""
        if not blocks:
            return []
        (a, b), (c, d) = self.move.tolist()
        other, main, back = 0.0, 0.0, []
        for i, s in enumerate(self.scores(blocks)):
            if i:
                from_0, from_1 = (other + a >= main + c), (other + b >= main + d)
                back.append((0 if from_0 else 1, 0 if from_1 else 1))
                other, main = (other + a if from_0 else main + c), (other + b if from_1 else main + d)
            main += s
        label = int(main > other)
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]

    def fit(self, pages: list[tuple[list[Block], list[int]]], epochs: int = 12, rate: float = 0.3, decay: float = 1e-4) -> Chain:
        """AdaGrad on the log likelihood of the labels; expectations by the forward and backward recursions."""
        ready = [(np.array([k for f in fs for k in f]), np.array([len(f) for f in fs]), np.array(y)) for (bs, y) in pages if bs for fs in (features(bs),)]
        sq_w, sq_b, sq_m = np.full(FEATURES, 1e-6), 1e-6, np.full((2, 2), 1e-6)
        order = list(range(len(ready)))
        rng = random.Random(5)
        for _ in range(epochs):
            rng.shuffle(order)
            for p in order:
                ids, sizes, y = ready[p]
                owner = np.repeat(np.arange(len(y)), sizes)
                s = np.bincount(owner, weights=self.weight[ids], minlength=len(y)) + self.bias
                node = np.stack([np.zeros(len(y)), s], axis=1)
                n = len(y)
                fw, bw = np.zeros((n, 2)), np.zeros((n, 2))
                fw[0] = node[0]
                for i in range(1, n):
                    fw[i] = node[i] + np.logaddexp(fw[i - 1][0] + self.move[0], fw[i - 1][1] + self.move[1])
                for i in range(n - 2, -1, -1):
                    t = self.move + node[i + 1] + bw[i + 1]
                    bw[i] = np.logaddexp(t[:, 0], t[:, 1])
                z = np.logaddexp(*fw[-1])
                miss = y - np.exp(fw + bw - z)[:, 1]
                g = np.bincount(ids, weights=miss[owner], minlength=FEATURES)
                touched = np.unique(ids)
                g_t = g[touched] - decay * self.weight[touched]
                sq_w[touched] += g_t**2
                self.weight[touched] += rate * g_t / np.sqrt(sq_w[touched])
                sq_b += miss.sum() ** 2
                self.bias += rate * miss.sum() / np.sqrt(sq_b)
                g_m = np.zeros((2, 2))
                np.add.at(g_m, (y[:-1], y[1:]), 1.0)
                if n > 1:
                    g_m -= np.exp(fw[:-1, :, None] + self.move + (node + bw)[1:, None, :] - z).sum(0)
                g_m -= decay * self.move
                sq_m += g_m**2
                self.move += rate * g_m / np.sqrt(sq_m)
        return self


def labelled_pages(n: int = 700, seed: int = 11) -> list[tuple[str, list[str]]]:
    """(page, texts of its main blocks): made-up pages of many layouts, with menus, headers, footers, sidebars, notices, adverts,
    forms, related links and readers' comments around and within the article, and with tags left open and pages cut off."""
    rng = random.Random(seed)
    syllables = "ba der ing ou the or en est ti ver lo ra que men du is an ka sho li".split()

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def sentence(low: int = 4, high: int = 16) -> str:
        return " ".join(word() for _ in range(rng.randint(low, high))).capitalize() + rng.choice("....?!")

    def text(k: int) -> str:
        return " ".join(sentence() for _ in range(k))

    def attr(*names: str) -> str:
        return rng.choice(["", f' class="{rng.choice(names)}"', f' id="{rng.choice(names)}"', f" class='{rng.choice(names)} {word()}'"])

    def named(*names: str) -> str:
        return rng.choice([f' class="{rng.choice(names)}"', f' id="{rng.choice(names)}"', f' class="{word()} {rng.choice(names)}"'])

    def links(k: int, sep: str = "") -> str:
        return sep.join(f'<li><a href="/{word()}">{word().capitalize()}</a></li>' for _ in range(k))

    def other(kind: str) -> str:
        k = rng.randint(3, 8)
        body = rng.choice([text(rng.randint(1, 3)), f"<p>{text(1)}</p>", f"<p>{text(1)}<p>{sentence()}"])
        return {
            "nav": lambda: rng.choice([f"<nav{attr('menu', 'navbar')}><ul>{links(k)}</ul></nav>", f"<div{named('nav', 'menu', 'navigation', 'topnav', 'breadcrumbs')}>{' | '.join(f'<a href=#>{word()}</a>' for _ in range(k))}</div>", f"<ul{named('menu', 'nav')}>{links(k)}</ul>"]),
            "header": lambda: rng.choice([f"<header{attr('header', 'masthead')}><a href=/>{word()}</a><p>{sentence(2, 5)}</p></header>", f"<div{named('header', 'masthead', 'banner', 'topbar')}>{sentence(2, 6)}</div>", f"<header><h1>{word()} {word()}</h1></header>"]),
            "footer": lambda: rng.choice([f"<footer{attr('footer')}>&copy; {word()}.example &middot; {sentence()}", f"<footer>{body}</footer>", f"<div{named('footer', 'copyright', 'legal', 'bottom')}>{body}</div>", f"<footer><p>&copy; 20{rng.randint(10, 25)} {word()}</p><ul>{links(3)}</ul></footer>"]),
            "aside": lambda: rng.choice([f"<aside{attr('sidebar', 'widget')}>{body}</aside>", f"<aside><h3>{word()}</h3>{body}<ul>{links(3)}</ul></aside>", f"<div{named('sidebar', 'widget', 'related', 'recommended', 'trending', 'rail')}><h3>{sentence(2, 4)}</h3>{body}<ul>{links(k)}</ul></div>"]),
            "ad": lambda: rng.choice([f"<div{named('ad', 'ads', 'advert', 'sponsored', 'promo', 'banner')}>{body}</div>", f"<section{named('ad', 'promo', 'sponsor')}>{body}</section>", f"<ins{named('ad')}></ins><div{named('advertisement', 'adslot')}><p>{text(1)}</p></div>"]),
            "notice": lambda: rng.choice([f"<div{named('cookie', 'notice', 'consent', 'gdpr', 'alert', 'popup', 'modal', 'newsletter', 'subscribe')}>{body}<button>{word()}</button></div>", f'<div role="{rng.choice(["alert", "dialog", "alertdialog", "banner"])}">{body}</div>', f"<dialog open>{body}</dialog>"]),
            "form": lambda: f"<form{attr('search', 'login', 'signup')}><label>{word()}</label><input name=q><p>{sentence()}</p><button>{word()}</button></form>",
            "comments": lambda: rng.choice([f"<section{named('comments', 'comment', 'responses', 'discussion', 'replies')}><h2>{word()}</h2>" + "".join(f'<div class="comment"><p>{text(rng.randint(1, 3))}</p></div>' for _ in range(rng.randint(1, 4))) + "</section>", f"<div{named('comments', 'disqus', 'respond')}><ol>" + "".join(f"<li><p>{text(rng.randint(1, 3))}</p></li>" for _ in range(rng.randint(1, 4))) + "</ol></div>", f'<ul class="comment-list">' + "".join(f'<li class="comment">{text(rng.randint(1, 2))}</li>' for _ in range(rng.randint(1, 4))) + "</ul>"]),
            "share": lambda: f"<div{named('share', 'social', 'tags', 'byline', 'meta')}>{' '.join(f'<a href=#>{word()}</a>' for _ in range(k))}</div>",
        }[kind]()

    def main() -> tuple[list[str], list[str]]:
        pieces, gold = [], []

        def add(before: str, t: str, after: str) -> None:
            shown = t.replace(" ", rng.choice([" ", " ", "\n  "]), 1)
            if rng.random() < 0.2 and " " in t:
                a, b = t.split(" ", 1)
                shown = f"<b>{a}</b> {b}" if rng.random() < 0.5 else f'{a} <a href="/{word()}">{b[:8]}</a>{b[8:]}'
            pieces.append(before + shown + after)
            gold.append(_SPACE.sub(" ", t))

        if rng.random() < 0.85:
            add("<h1>", sentence(3, 9), "</h1>")
        for _ in range(rng.choice([1, 2, 4, 8, 14])):
            kind = rng.random()
            if kind < 0.12:
                add(rng.choice(["<h2>", "<h3>"]), sentence(2, 7), "")
                pieces[-1] += "</h2>" if "<h2>" in pieces[-1] else "</h3>"
            elif kind < 0.2:
                pieces.append(rng.choice(["<ul>", "<ol>"]))
                for _ in range(rng.randint(2, 4)):
                    add("<li>", sentence(1, 12), rng.choice(["", "</li>"]))
                pieces.append("</ul>" if "<ul>" in pieces[-3:] or pieces.count("<ul>") > pieces.count("</ul>") else "</ol>")
            elif kind < 0.25:
                add("<blockquote>", text(rng.randint(1, 2)), "</blockquote>")
            elif kind < 0.3:
                add("<figure><figcaption>", sentence(), "</figcaption></figure>")
            elif kind < 0.32:
                add(rng.choice(["<p class=caption>", '<div class="caption">', '<div class="image"><img src=x><p>', "<figcaption>"]), sentence(), "")
                pieces[-1] += "</p></div>" if "image" in pieces[-1] else "</div>" if "<div" in pieces[-1] else "</figcaption>" if "<figc" in pieces[-1] else "</p>"
            elif kind < 0.34:
                pieces.append("<table>")
                for _ in range(rng.randint(1, 3)):
                    add(rng.choice(["<tr><td>", "<tr><th>"]), sentence(1, 4), "</td>")
                    add("<td>", sentence(1, 4), "</td></tr>")
                pieces.append("</table>")
            elif kind < 0.37:
                pieces.append("<dl>")
                for _ in range(rng.randint(1, 3)):
                    add("<dt>", sentence(1, 3).rstrip(".?!"), rng.choice(["</dt>", ""]))
                    add("<dd>", rng.choice([sentence(1, 12), text(2)]), rng.choice(["</dd>", ""]))
                pieces.append("</dl>")
            elif kind < 0.41:
                box = rng.choice(["div", "div", "section", "aside"])
                pieces.append(f"<{box}" + named("note", "callout", "tip", "infobox", "box", "highlight", "pullquote", "summary", "abstract", "lead", "example", "warning", "definition") + ">")
                for _ in range(rng.randint(1, 2)):
                    add("<p>", text(rng.randint(1, 3)), "</p>")
                pieces.append(f"</{box}>")
            elif kind < 0.43:
                add("<details><summary>", sentence(2, 6), "</summary>")
                add("<p>", text(rng.randint(1, 2)), "</p></details>")
            elif kind < 0.46:
                add("<pre>", sentence(2, 6), "</pre>")
            elif kind < 0.5:
                add("<p>", " | ".join(word() for _ in range(rng.randint(2, 9))) + rng.choice(["", ".", " |"]), rng.choice(["</p>", ""]))
            elif kind < 0.55:
                add(rng.choice(["<p>", "<p><b>"]), " ".join([word()] * rng.randint(1, 9)), rng.choice(["</p>", "", "<br>"]))
            else:
                add(rng.choice(["<p>", "<p><b>"]), text(rng.choice([1, 1, 2, 4, 7])), rng.choice(["</p>", "</p>", "", "<br>"]))
        return pieces, gold

    out = []
    for _ in range(n):
        kinds = ["nav", "header", "footer", "aside", "ad", "notice", "form", "comments", "share"]
        before = [other(k) for k in rng.sample(kinds[:7] + ["share"], rng.randint(1, 4)) if k != "footer"]
        after = [other(k) for k in rng.sample(["aside", "ad", "notice", "form", "comments", "share", "nav"], rng.randint(0, 3))] + ([other("footer")] if rng.random() < 0.85 else [])
        pieces, gold = main()
        if rng.random() < 0.45:
            for _ in range(rng.randint(1, 2)):
                pieces.insert(rng.randint(1, len(pieces)), other(rng.choice(["ad", "aside", "notice", "form", "share", "comments"]))) if not any(x in ("<ul>", "<ol>") for x in pieces) else pieces.append(other(rng.choice(["ad", "comments", "share"])))
        wrap = rng.choice([("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), (f"<div{named('content', 'article', 'post', 'entry', 'main', 'story')}>", "</div>"), ("<section>", "</section>"), ("<div>", "</div>"), ("", "")])
        page = f"<!DOCTYPE html><html><head><title>{sentence()}</title><style>p{{}}</style><script>var t='<p>x</p>';</script></head><body>" + "".join(before) + wrap[0] + "".join(pieces) + wrap[1] + "".join(after)
        out.append((page + "</body></html>" * (rng.random() < 0.8), gold))
    return out


def label_blocks(page: str, gold: list[str]) -> tuple[list[Block], list[int]]:
    blocks, known = blocks_of(page), set(gold)
    return blocks, [int(b[1] in known) for b in blocks]


@lru_cache(maxsize=1)
def default_chain() -> Chain:
    return Chain().fit([label_blocks(*p) for p in labelled_pages()])


def extract(page: str | None, chain: Chain) -> str:
    """The main blocks of a page, one a line."""
    if not page:
        return ""
    blocks = blocks_of(page)
    return "\n".join(b[1] for b, y in zip(blocks, chain.decode(blocks)) if y)


def extract_pages(pages: DataFrame, chain: Chain) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html): the whole main text, empty for null, empty
    and text-free html. Rows repeat as in pages; other columns are not carried; an empty table gives no rows."""

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        for x in batches:
            texts = [extract(h, chain) for h in x["html"]]
            yield pd.DataFrame({"page_id": x["page_id"], "url": x["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return batched(pages.select("page_id", "url", "html")).mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"), default_chain())
