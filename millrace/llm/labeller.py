"""Recurrent block labeller: a bidirectional LSTM over a page's blocks.

A block's input is the hashed names of its tag path, the hashed words of its
whole text, and a few numbers.  The network reads the blocks of a page in both
directions, so that every decision sees the whole page, and tells article text
from the rest.  It is trained here, on pages that `training_pages` composes:
article bodies and boilerplate in many usual markups, with made-up words.
"""

from __future__ import annotations

import functools
import random
import zlib

import numpy as np

from .pages import Block, blocks_of

PATH, WORDS, NUMBERS, HIDDEN = 192, 160, 4, 20
#: Bound of the training set, and passes over it.
PAGES, EPOCHS, SEED = 1400, 10, 7


@functools.lru_cache(100_000)
def _path_slots(path: tuple[str, ...]) -> np.ndarray:
    """Slots of the names on a path; the two innermost elements' names have slots of their own besides."""
    inner = [f"<{x}" for x in path[-2:]]
    return np.array([zlib.crc32(x.encode("utf-8", "replace")) % PATH for x in (*path, *inner)], np.int64)


def features(blocks: list[Block]) -> np.ndarray:
    """[blocks, PATH + WORDS + NUMBERS] inputs."""
    n = len(blocks)
    out = np.zeros((n, PATH + WORDS + NUMBERS), np.float32)
    words = [b.text.split(" ") for b in blocks]
    sizes = np.array([len(w) for w in words], np.int64)
    for i, b in enumerate(blocks):
        np.add.at(out[i], _path_slots(b.path), 0.5)
    np.minimum(out, 1, out=out)
    codes = np.fromiter((zlib.crc32(w.lower().encode("utf-8", "replace")) for line in words for w in line), np.int64, int(sizes.sum()))
    row = np.repeat(np.arange(n), sizes)
    sign = np.where(codes >> 16 & 1, 1.0, -1.0)
    bag = np.bincount(row * WORDS + codes % WORDS, sign, n * WORDS).reshape(n, WORDS)
    # a word that fills its line doesn't drown the rest
    out[:, PATH : PATH + WORDS] = np.clip(bag / np.maximum(sizes, 1)[:, None], -0.25, 0.25)
    out[:, PATH + WORDS] = np.log1p(sizes) / 4
    out[:, PATH + WORDS + 1] = [b.links for b in blocks]
    out[:, PATH + WORDS + 2] = [b.text[-1] in ".!?…:\"»”" for b in blocks]
    out[:, PATH + WORDS + 3] = [b.text[0] in "©®→»|" for b in blocks]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """The network; score(pages) gives each block's log odds of being article text."""

    def __init__(self, seed: int = SEED):
        draw = np.random.default_rng(seed)
        size = PATH + WORDS + NUMBERS
        self.w = {}
        for side in "fb":
            self.w[f"x{side}"] = (draw.standard_normal((size, 4 * HIDDEN)) / np.sqrt(12)).astype(np.float32)
            self.w[f"h{side}"] = (draw.standard_normal((HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.w[f"b{side}"] = bias
        self.w["o"] = (draw.standard_normal((2 * HIDDEN, 1)) / np.sqrt(2 * HIDDEN)).astype(np.float32)
        self.w["s"] = np.zeros((size, 1), np.float32)
        self.w["c"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool):
        """Hidden states [time, page, HIDDEN] of one direction; mask [time, page]."""
        gates_x = x @ self.w[f"x{side}"] + self.w[f"b{side}"]
        steps, pages = mask.shape
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        out, tape = np.zeros((steps, pages, HIDDEN), np.float32), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = gates_x[t] + h @ self.w[f"h{side}"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            new = f * c + i * g
            tc = np.tanh(new)
            m = mask[t][:, None]
            if keep:
                tape.append((t, h, c, i, f, o, g, tc))
            c = np.where(m, new, c)
            h = np.where(m, o * tc, h)
            out[t] = h
        return out, tape

    def _pad(self, pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        steps = max(map(len, pages))
        x = np.zeros((steps, len(pages), PATH + WORDS + NUMBERS), np.float32)
        mask = np.zeros((steps, len(pages)), bool)
        for k, page in enumerate(pages):
            x[: len(page), k], mask[: len(page), k] = page, True
        return x, mask

    def score(self, pages: list[np.ndarray], cells: int = 16_000) -> list[np.ndarray]:
        """Log odds of every block of every page (inputs of features()), pages of like length together."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: len(pages[i]))
        while order:
            n = max(1, min(len(order), cells // len(pages[order[-1]])))
            part, order = order[-n:], order[:-n]
            x, mask = self._pad([pages[i] for i in part])
            both = np.concatenate([self._run(x, mask, side, False)[0] for side in "fb"], axis=2)
            odds = (both @ self.w["o"] + x @ self.w["s"] + self.w["c"])[:, :, 0]
            for k, i in enumerate(part):
                out[i] = odds[: len(pages[i]), k]
        return out

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, batch: int = 40, rate: float = 0.015, seed: int = SEED) -> None:
        """Backpropagation through time with Adam."""
        draw = np.random.default_rng(seed)
        mean, square, step = {k: np.zeros_like(v) for k, v in self.w.items()}, {k: np.zeros_like(v) for k, v in self.w.items()}, 0
        for epoch in range(epochs):
            order = draw.permutation(len(pages))
            for at in range(0, len(order), batch):
                part = sorted(order[at : at + batch], key=lambda i: len(pages[i]))
                grads = self._gradients([pages[i] for i in part], [labels[i] for i in part])
                step += 1
                for k, g in grads.items():
                    g = np.clip(g, -1, 1)
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.999 * square[k] + 0.001 * g * g
                    now = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
                    self.w[k] = self.w[k] - now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)

    def _gradients(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        x, mask = self._pad(pages)
        y = np.zeros(mask.shape, np.float32)
        for k, l in enumerate(labels):
            y[: len(l), k] = l
        runs = {side: self._run(x, mask, side, True) for side in "fb"}
        both = np.concatenate([runs[s][0] for s in "fb"], axis=2)
        odds = (both @ self.w["o"] + x @ self.w["s"] + self.w["c"])[:, :, 0]
        error = (np.where(mask, _sigmoid(odds) - y, 0) / mask.sum()).astype(np.float32)[:, :, None]
        over = lambda a, b: a.reshape(-1, a.shape[2]).T @ b.reshape(-1, b.shape[2])  # noqa: E731, sum over blocks and pages
        grads = {"o": over(both, error), "s": over(x, error), "c": error.sum((0, 1))}
        d_both = error @ self.w["o"].T
        for n, side in enumerate("fb"):
            d_out, tape = d_both[:, :, n * HIDDEN : (n + 1) * HIDDEN], runs[side][1]
            dz = np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
            before = np.zeros((*mask.shape, HIDDEN), np.float32)
            dh, dc = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
            for t, h, c, i, f, o, g, tc in reversed(tape):
                m = mask[t][:, None]
                dh = dh + d_out[t]
                own_h, own_c = np.where(m, dh, 0), np.where(m, dc, 0)
                own_c = own_c + own_h * o * (1 - tc * tc)
                dz[t] = np.concatenate((own_c * g * i * (1 - i), own_c * c * f * (1 - f), own_h * tc * o * (1 - o), own_c * i * (1 - g * g)), axis=1)
                before[t] = h
                dh = np.where(m, dz[t] @ self.w[f"h{side}"].T, dh)
                dc = np.where(m, own_c * f, dc)
            grads[f"x{side}"] = over(x, dz)
            grads[f"h{side}"] = over(before, dz)
            grads[f"b{side}"] = dz.sum((0, 1))
        return grads


#: Markup of article bodies and of boilerplate: opening tags, innermost last.
BODIES = (
    ("article",), ("main", "article"), ('div class="content"', "article"), ('div id="content"',), ('div class="post-content"',), ("main",), ('div class="entry-content"',),
    ('article class="post"',), ('section class="story"',), ('div class="article-body"',), ('div class="main"', 'div class="text"'), ('main id="main"', 'div class="article"'), ('td class="body"',), (),
)
LISTS = (("nav", "ul"), ('div class="menu"', "ul"), ('ul class="nav"',), ('div id="sidebar"', "ul"), ("aside", "ul"), ('div class="breadcrumb"',), ('div class="related"', "ul"), ('footer class="site-footer"', "ul"), ("header", "nav", "ul"), ('div role="navigation"',), ('ul class="pagination"',), ('div class="tags"', "ul"), ('aside class="sidebar"', "ul"))
NOTES = (
    ('div class="ad"',), ('div class="advert"',), ('div class="ads-banner"',), ('div id="cookie-notice"',), ('div class="cookie"',), ('div class="notice"',), ('div class="promo"',), ("aside",), ('aside class="sidebar"',), ('div class="sidebar"',), ("footer",),
    ('div id="footer"',), ("header",), ('div class="header"',), ('div class="newsletter"',), ("form",), ('form class="search"',), ('div class="share social"',), ('div class="banner"',), ('div class="sponsored"',), ('div class="popup modal"',), ('div class="consent"',), ('section class="subscribe"',), ('div class="byline meta"',), ('div class="widget"',),
)
COMMENTS = (('div class="comments"',), ('section id="comments"',), ('div class="comment"',), ('ol class="comment-list"',), ('div class="user-comment reply"',), ('section class="comments"', 'div class="comment"'), ('section class="responses"',), ('div id="disqus"',), ('article class="comment"',))


#: Names that wrappers of any part of a page may have: they tell nothing.
NEUTRAL = ("entry", "single", "page", "wrapper", "container", "row", "col", "inner", "box", "block", "wrap", "section", "item", "area", "holder", "layout", "grid", "panel", "card", "hentry", "post", "view", "left", "right", "top", "node", "module")
#: What notices, forms and adverts say, whatever their markup.
SAYINGS = (
    "We use cookies", "Accept all", "This site uses cookies", "Privacy policy", "Terms of use", "All rights reserved", "Sign up for our newsletter", "Subscribe now", "Log in", "Share this", "Advertisement", "Sponsored", "Follow us", "Read more", "Related articles", "Leave a reply", "Your email address",
    "Wir verwenden Cookies", "Alle akzeptieren", "Datenschutz", "Impressum", "Alle Rechte vorbehalten", "Newsletter abonnieren", "Anmelden", "Anzeige", "Teilen", "Mehr lesen",
    "Usamos cookies", "Aceptar todo", "Política de privacidad", "Todos los derechos reservados", "Suscríbete", "Iniciar sesión", "Publicidad", "Compartir", "Leer más",
    "Nous utilisons des cookies", "Tout accepter", "Mentions légales", "Tous droits réservés", "Abonnez-vous", "Connexion", "Publicité", "Partager", "Lire la suite",
)


def training_pages(n: int, seed: int = SEED, hard: bool = True) -> list[tuple[str, list[bool]]]:
    """(html, whether each block is article text) of n composed pages; hard ones have markup that says nothing, notices told by their words, and headers and footers inside articles."""
    draw = random.Random(seed)
    letters = "aeioubcdfghlmnprstvwéßñüø"

    def word() -> str:
        return "".join(draw.choice(letters) for _ in range(draw.randint(1, 9)))

    def words(a: int, b: int, end: str = "") -> str:
        line = [word() + ("," if draw.random() < 0.1 else "") for _ in range(draw.randint(a, b))]
        if draw.random() < 0.06:
            line = [line[0]] + [line[-1]] * (len(line) - 1)
        elif draw.random() < 0.03:
            line = [x for w in line for x in (w, "|")]
        if draw.random() < 0.15:
            line = [w.upper() for w in line]
        if draw.random() < 0.2:
            line = [w + draw.choice(("***", "!!", "###", "&amp;", "$")) for w in line]
        return " ".join(line).capitalize() + end

    def wrap(tags: tuple[str, ...], inner: str) -> str:
        for t in reversed(tags):
            inner = f"<{t}>{inner}</{t.split()[0]}>"
        return inner

    def neutral() -> str:
        """A wrapper whose name says nothing of its content."""
        names = [draw.choice(NEUTRAL) if draw.random() < 0.6 else word() for _ in range(draw.randint(1, 2))]
        return draw.choice(("div", "div", "section")) + draw.choice((' class="{}"', ' class="{}"', ' id="{}"', "")).format(draw.choice(" -").join(names))

    def wrapped(known: tuple, share: float) -> tuple[str, ...]:
        """Markup that is known for the part, or in a share of cases says nothing; either may lie in more of the latter."""
        if not hard:
            return draw.choice(known)
        inner = (neutral(),) if draw.random() < share else draw.choice(known)
        return (*(neutral() for _ in range(draw.choice((0, 0, 0, 1, 2)))), *inner)

    def saying() -> str:
        return ". ".join(draw.sample(SAYINGS, draw.randint(1, 3)))

    def menu(out: list) -> None:
        tags, n = wrapped(LISTS, 0.2), draw.randint(2, 8)
        item = "li" if any(t.split()[0] in ("ul", "ol") for t in tags) else draw.choice(("div", "p"))
        lines = [f'<{item}><a href="/{word()}">{words(1, 3)}</a></{item}>' for _ in range(n)]
        out.append((wrap(tags, "".join(lines)), [False] * n))

    def note(out: list, inside: bool = False) -> None:
        # outside articles a notice may be told by its words alone, and its markup says nothing
        told = hard and not inside and draw.random() < 0.45
        tags, kind = wrapped(NOTES, 0.6) if told else draw.choice(NOTES), draw.choice(("", "p", "p", "div"))
        if told and draw.random() < 0.3:  # a bare paragraph
            tags, kind = (), "p"
        n = draw.choice((1, 1, 1, 2, 3))
        start = draw.choice(("", "", "&copy; ", "Cookies ", "Ad: "))
        lines = [f"{saying()}{draw.choice(('', '.', ' ' + words(1, 8, '.')))}" if told else f"{start}{words(2, 40, draw.choice(('', '.')))}" for _ in range(n if kind else 1)]
        out.append((wrap(tags, "".join(f"<{kind}>{x}</{kind}>" if kind else x for x in lines)), [False] * len(lines)))

    def remarks(out: list) -> None:
        tags, n = (*(neutral() for _ in range(draw.choice((0, 0, 1)))), *draw.choice(COMMENTS)), draw.randint(1, 5)
        lines = [draw.choice(("<p>{}</p>", "<div>{}</div>", "<li>{}</li>")).format(words(2, 60, ".")) for _ in range(n)]
        out.append((wrap(tags, "".join(lines)), [False] * n))

    def body(out: list) -> None:
        parts, marks = [], []
        if draw.random() < 0.85:
            head = f"<h1>{words(1, 12)}</h1>"
            marks.append(True)
            if hard and draw.random() < 0.25:  # an article's own header
                if draw.random() < 0.5:
                    head += f"<{(h := draw.choice(('h2', 'p')))}>{words(3, 12)}</{h}>"
                    marks.append(True)
                head = f"<header{draw.choice(('', '', ' class="' + draw.choice(NEUTRAL) + '"'))}>{head}</header>"
            parts.append(head)
        for _ in range(draw.choice((0, 1, 2, 4, 8, 16, 30)) if parts else draw.randint(1, 12)):
            kind = draw.random()
            if kind < 0.72:
                # an article may say what notices say
                text = saying() + "." if draw.random() < 0.06 else words(1, draw.choice((5, 20, 60)), ".")
                parts.append(draw.choice(("<p>{}</p>", "<p>{}</p>", "<p><b>{}<br>", "<p>{}", "<p><a href='/x'>" + word() + "</a> {}</p>", "<div>{}</div>")).format(text))
                marks.append(True)
            elif kind < 0.8:
                parts.append(f"<{(h := draw.choice(('h2', 'h3')))}>{words(1, 8)}</{h}>")
                marks.append(True)
            elif kind < 0.9:
                k = draw.randint(1, 5)
                parts.append(f"<ul>{''.join(f'<li>{words(1, 15)}</li>' for _ in range(k))}</ul>")
                marks += [True] * k
            elif kind < 0.94:
                parts.append(f"<{(h := draw.choice(('blockquote', 'pre', 'figcaption')))}>{words(2, 25, '.')}</{h}>")
                marks.append(True)
            else:
                inside: list = []
                draw.choice((functools.partial(note, inside=True), menu))(inside)
                parts.append(inside[0][0])
                marks += inside[0][1]
        if draw.random() < 0.1:
            inside = []
            remarks(inside)
            parts.append(inside[0][0])
            marks += inside[0][1]
        tags = wrapped(BODIES, 0.25)
        if hard and tags and tags[-1].split()[0] == "article" and draw.random() < 0.5:  # an article's own footer
            parts.append(f"<footer>{draw.choice(('<p>{}</p>', '{}', '<div>{}</div>')).format(words(1, 9) if draw.random() < 0.6 else saying())}</footer>")
            marks.append(False)
        out.append((wrap(tags, "".join(parts)), marks))

    made = []
    for _ in range(n):
        out: list = []
        for _ in range(draw.randint(0, 3)):
            draw.choice((menu, note))(out)
        body(out)
        for _ in range(draw.randint(0, 3)):
            draw.choice((menu, note, note, remarks))(out)
        title = words(1, 10)
        page = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{''.join(x for x, _ in out)}</body></html>"
        made.append((page, [False] + [m for _, marks in out for m in marks]))
    return made


def training_set(n: int, seed: int = SEED, hard: bool = True) -> tuple[list[np.ndarray], list[np.ndarray]]:
    pages, labels = [], []
    for page, marks in training_pages(n, seed, hard):
        found = blocks_of(page)
        if len(found) == len(marks):
            pages.append(features(found))
            labels.append(np.array(marks, np.float32))
    return pages, labels


@functools.cache
def trained(pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """The trained network; the same in every run."""
    net = Labeller(seed)
    net.fit(*training_set(pages, seed), epochs=epochs, seed=seed)
    return net
