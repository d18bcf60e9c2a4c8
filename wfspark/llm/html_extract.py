"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks (``html_blocks``). Each block is a vector of its hashed tag path
(tags, and the words of class, id and role), its hashed words and a few measures; a bidirectional LSTM in numpy reads the whole
sequence and labels every block with the page in view. Its weights are fitted here, on pages that a seeded
generator lays out, so that the labels are known; training is the same in every session and takes seconds.

Null, empty and text-free pages give an empty text. Repeated rows are labelled each; extra columns are ignored, whatever their names;
an empty table gives no rows. Pages of any length and depth are scanned once and read whole; memory follows the longest
page's blocks. A probability of just the threshold counts as main text.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wfspark.llm.columns import frugal, runs, span_hashes, spans, texts
from wfspark.llm.html_blocks import Blocks, blocks

PATH_BUCKETS, PATH_DIM = 1024, 24
WORD_BUCKETS, WORD_DIM = 512, 8
MEASURES = 9
INPUT, HIDDEN = 32, 24
#: Blocks whose vectors and gates are worked out at once.
SOME = 1 << 14


@lru_cache(1 << 16)
def _bucket(name: str) -> int:
    return crc32(name.encode()) % PATH_BUCKETS


class Pages:
    """Features of the blocks of several pages, in page order."""

    def __init__(self, pages: list[Blocks]):
        flat = [x for page in pages for x in page.texts]
        self.sizes = np.array([len(page) for page in pages], np.int64)
        # the sum over a block's path is a running sum over events, where an element's end takes back what its start added
        self.tokens = np.array([_bucket(x) for page in pages for x in page.names], np.int64)
        self.signs = np.array([x for page in pages for x in page.signs], np.int64)
        begin = np.cumsum([0, *(len(page.names) for page in pages)])[:-1]
        self.at = np.array([x for page in pages for x in page.at], np.int64) + np.repeat(begin, self.sizes)
        self.depth = np.maximum(np.concatenate([[0], np.cumsum(self.signs)])[self.at], 1)
        t = texts(pa.array([x.lower() for x in flat], pa.large_string()))
        starts, ends = spans(t)
        self.word_tokens = (span_hashes(t.data, starts, ends) % np.uint64(WORD_BUCKETS)).astype(np.int64)
        self.word_first = t.per_document(starts)
        self.word_sizes = np.diff(self.word_first)
        chars = np.array([len(x) for x in flat], np.float32)
        count = lambda marks: np.array([sum(map(x.count, marks)) for x in flat], np.float32)
        place = np.concatenate([np.arange(n) / max(n - 1, 1) for n in self.sizes]) if flat else np.empty(0)
        self.measures = np.stack(
            [
                np.log1p(chars) / 4,
                np.log1p(self.word_sizes) / 3,
                np.array([x for page in pages for x in page.linked], np.float32) / np.maximum(chars, 1),
                20 * count(".,;:!?") / np.maximum(chars, 1),
                np.array([x[-1] in ".!?\"”»" for x in flat], np.float32),
                np.array([x[0].isupper() for x in flat], np.float32),
                10 * count("|©•»›·") / np.maximum(chars, 1),
                place,
                np.repeat(np.log1p(self.sizes), self.sizes) / 4,
            ],
            axis=1,
        ).astype(np.float32)

    def vectors(self, w: dict[str, np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
        """The raw vectors of all blocks, some at a time: first, end, vectors."""
        done, total = 0, np.zeros(PATH_DIM)
        for a in range(0, len(self.at), SOME):
            b = min(a + SOME, len(self.at))
            new = slice(done, self.at[b - 1])
            run = np.concatenate([total[None], total + np.cumsum(w["path"][self.tokens[new]] * self.signs[new, None], axis=0, dtype=np.float64)])
            path = run[self.at[a:b] - done] / np.sqrt(self.depth[a:b])[:, None]
            done, total = int(self.at[b - 1]), run[-1]
            first = self.word_first[a:b]
            words = np.add.reduceat(w["word"][self.word_tokens[first[0] : self.word_first[b]]], first - first[0], axis=0) / np.maximum(self.word_sizes[a:b], 1)[:, None]
            yield a, b, np.concatenate([path, words, self.measures[a:b]], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _read(x: np.ndarray, mask: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, tape: list | None = None) -> np.ndarray:
    """States of one direction of the LSTM over (time, page, input); masked steps keep the state. ``tape`` gets what the gradient needs."""
    steps, n, _ = x.shape
    h, c = np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype)
    out = np.empty((steps, n, HIDDEN), x.dtype)
    every = max(1, SOME // n)
    for k in range(steps):
        if k % every == 0:
            gates = x[k : k + every] @ wx + b
        z = gates[k % every] + h @ wh
        ifo = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = ifo[:, :HIDDEN], ifo[:, HIDDEN : 2 * HIDDEN], ifo[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[k][:, None]
        new_c = m * (f * c + i * g) + (1 - m) * c
        tc = np.tanh(new_c)
        new_h = m * o * tc + (1 - m) * h
        if tape is not None:
            tape.append((h, c, i, f, o, g, tc))
        h, c = new_h, new_c
        out[k] = h
    return out


def _unread(x: np.ndarray, mask: np.ndarray, wx: np.ndarray, wh: np.ndarray, tape: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of ``_read``: of its input and its weights."""
    dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
    dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN))
    dwh = np.zeros_like(wh)
    for k in range(len(x) - 1, -1, -1):
        h, c, i, f, o, g, tc = tape[k]
        m = mask[k][:, None]
        dh = dh + dout[k]
        dnc = dc + dh * m * o * (1 - tc * tc)
        dz = m * np.concatenate([dnc * g * i * (1 - i), dnc * c * f * (1 - f), dh * tc * o * (1 - o), dnc * i * (1 - g * g)], axis=1)
        dz_all[k] = dz
        dwh += h.T @ dz
        dh = dh * (1 - m) + dz @ wh.T
        dc = dnc * (m * f + (1 - m))
    flat = dz_all.reshape(-1, 4 * HIDDEN)
    return dz_all @ wx.T, x.reshape(-1, x.shape[2]).T @ flat, dwh, flat.sum(axis=0)


class Labeller:
    """Bidirectional LSTM over block vectors."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, seed: int) -> Labeller:
        r = np.random.default_rng(seed)
        scale = lambda *shape: r.normal(0, 1 / np.sqrt(shape[0]), shape)
        w = {"path": r.normal(0, 0.3, (PATH_BUCKETS, PATH_DIM)), "word": r.normal(0, 0.3, (WORD_BUCKETS, WORD_DIM)), "in": scale(PATH_DIM + WORD_DIM + MEASURES, INPUT), "in_b": np.zeros(INPUT)}
        for side in ("f", "b"):
            w |= {f"{side}x": scale(INPUT, 4 * HIDDEN), f"{side}h": scale(HIDDEN, 4 * HIDDEN), f"{side}_b": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}
        return cls(w | {"out": scale(2 * HIDDEN, 1), "out_b": np.zeros(1)})

    def _pad(self, pages: Pages, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """Cell of every block in (time, page), and the mask."""
        steps, n = int(pages.sizes.max()), len(pages.sizes)
        time = np.concatenate([np.arange(k) for k in pages.sizes])
        cell = time * n + np.repeat(np.arange(n), pages.sizes)
        mask = np.zeros(steps * n, kind)
        mask[cell] = 1
        return cell, mask.reshape(steps, n)

    def forward(self, pages: Pages, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Probabilities, and with ``keep`` what the gradient needs; without it memory follows the padded cells."""
        w, kind = self.w, self.w["in"].dtype
        cell, mask = self._pad(pages, kind)
        x = np.zeros((mask.size, INPUT), kind)
        raws = []
        for a, b, raw in pages.vectors(w):
            x[cell[a:b]] = np.tanh(raw.astype(kind) @ w["in"] + w["in_b"])
            raws += [raw] if keep else []
        x = x.reshape(*mask.shape, INPUT)
        tapes = ([], []) if keep else (None, None)
        ahead = _read(x, mask, w["fx"], w["fh"], w["f_b"], tapes[0])
        back = _read(x[::-1], mask[::-1], w["bx"], w["bh"], w["b_b"], tapes[1])[::-1]
        both = [side.reshape(-1, HIDDEN)[cell] for side in (ahead, back)]
        p = _sigmoid(both[0] @ w["out"][:HIDDEN] + both[1] @ w["out"][HIDDEN:] + w["out_b"])[:, 0]
        return p, (np.concatenate(raws), cell, mask, x, *tapes, np.concatenate(both, axis=1)) if keep else ()

    def gradient(self, pages: Pages, truth: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        p, (raw, cell, mask, x, tape_f, tape_b, both) = self.forward(pages, keep=True)
        d = ((p - truth) / len(truth))[:, None]
        out = {"out": both.T @ d, "out_b": d.sum(axis=0)}
        dboth = np.zeros((mask.size, 2 * HIDDEN))
        dboth[cell] = d @ w["out"].T
        dboth = dboth.reshape(*mask.shape, 2 * HIDDEN)
        dx, out["fx"], out["fh"], out["f_b"] = _unread(x, mask, w["fx"], w["fh"], tape_f, dboth[:, :, :HIDDEN])
        dxb, out["bx"], out["bh"], out["b_b"] = _unread(x[::-1], mask[::-1], w["bx"], w["bh"], tape_b, dboth[::-1, :, HIDDEN:])
        flat = x.reshape(-1, INPUT)[cell]
        dpre = (dx + dxb[::-1]).reshape(-1, INPUT)[cell] * (1 - flat * flat)
        out["in"], out["in_b"] = raw.T @ dpre, dpre.sum(axis=0)
        draw = dpre @ w["in"].T
        by_event = np.zeros((len(pages.tokens) + 1, PATH_DIM))
        np.add.at(by_event, pages.at, draw[:, :PATH_DIM] / np.sqrt(pages.depth)[:, None])
        after = np.cumsum(by_event[::-1], axis=0)[::-1][1:]  # of all blocks that come after an event
        out["path"] = np.zeros_like(w["path"])
        np.add.at(out["path"], pages.tokens, after * pages.signs[:, None])
        out["word"] = np.zeros_like(w["word"])
        np.add.at(out["word"], pages.word_tokens, np.repeat(draw[:, PATH_DIM : PATH_DIM + WORD_DIM] / np.maximum(pages.word_sizes, 1)[:, None], pages.word_sizes, axis=0))
        return out

    def label(self, pages: list[Blocks], cells: int = 1 << 16) -> list[np.ndarray]:
        """Probability of main text of every block of each page. Pages of like length are read together, as many as fill ``cells`` padded
        places; one longer page goes by itself."""
        out: list[np.ndarray] = [np.empty(0)] * len(pages)
        full = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        while full:
            n = 1
            while n < len(full) and (n + 1) * len(pages[full[n]]) <= cells:
                n += 1
            part, full = full[:n], full[n:]
            p, _ = self.forward(Pages([pages[k] for k in part]))
            cuts = np.cumsum([len(pages[k]) for k in part])[:-1]
            for k, own in zip(part, np.split(p, cuts)):
                out[k] = own
        return out


# Pages whose labels are known. The lists are layouts and names in common use.
_MAIN_NAMES = "content main post entry article body story text page copy".split()
_SIDE = {
    "nav": "nav menu navigation navbar breadcrumb breadcrumbs topbar links".split(),
    "header": "header masthead banner top site branding".split(),
    "footer": "footer bottom copyright colophon legal".split(),
    "aside": "sidebar aside related widget rail recommended popular tags share social".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion".split(),
    "notice": "cookie cookies notice consent alert gdpr popup modal newsletter subscribe message".split(),
    "comments": "comments comment replies discussion disqus responses".split(),
    "form": "search login signup contact form feedback".split(),
}


class _Layout:
    """Lays out one page with the random source given and notes which leaf texts are main."""

    def __init__(self, r: random.Random):
        self.r = r
        parts = "".join(r.sample("bcdfghklmnprstvwz", 8)), "".join(r.sample("aeiouéäöàü", 5))
        self.syllables = [c + v + r.choice(["", "", "n", "r", "s", "t"]) for c in parts[0] for v in parts[1]]
        self.short = ["".join(r.sample(self.syllables, 1)) for _ in range(25)]
        self.out: list[str] = []
        self.labels: list[int] = []

    def word(self) -> str:
        return self.r.choice(self.short) if self.r.random() < 0.5 else "".join(self.r.choices(self.syllables, k=self.r.randint(1, 4)))

    def sentence(self, low: int = 1, high: int = 22) -> str:
        words = [self.word() + ("," if self.r.random() < 0.08 else "") for _ in range(self.r.randint(low, high))]
        return " ".join(words).capitalize() + "."

    def text(self, sentences: int) -> str:
        return " ".join(self.sentence() for _ in range(sentences))

    def leaf(self, before: str, text: str, after: str, main: bool) -> None:
        self.out.append(before + text + after)
        self.labels.append(int(main))

    def attribute(self, names: list[str]) -> str:
        r = self.r
        name = r.choice(names)
        if r.random() < 0.4:
            name = r.choice([f"{name}-{self.word()}", f"{self.word()}-{name}", f"{name} {self.word()}", f"site-{name}", f"{name}-wrapper"])
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def links(self, n: int) -> None:
        as_list = self.r.random() < 0.8
        self.out.append("<ul>" if as_list else "")
        for _ in range(n):
            text = " ".join(self.word() for _ in range(self.r.randint(1, 4)))
            tag = "li" if as_list else "div"
            self.leaf(f'<{tag}><a href="/{self.word()}">', text, f"</a></{tag}>", False)
        self.out.append("</ul>" if as_list else "")

    def side(self, kind: str) -> None:
        """A region that is not main text."""
        r = self.r
        semantic = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "comments": "section", "form": "form"}.get(kind, "div")
        tag = semantic if r.random() < 0.6 else "div"
        bare = tag in ("nav", "header", "footer", "aside", "form") and r.random() < 0.6
        self.out.append(f"<{tag}{'' if bare else self.attribute(_SIDE[kind])}>")
        if kind == "nav" or kind in ("header", "aside", "footer") and r.random() < 0.5:
            if kind == "aside":
                self.leaf("<h3>", self.sentence(1, 4).rstrip("."), "</h3>", False)
            self.links(r.randint(2, 9))
        if kind == "header":
            self.leaf(r.choice(["<div>", "<h1>", "<p>"]), " ".join(self.word() for _ in range(r.randint(1, 5))), "</p>", False)
        elif kind == "footer":
            mark = r.choice(["&copy; ", "© ", "", "Copyright "])
            text = f"{mark}{self.word()}.example.com {r.choice(['&middot;', '|', '-'])} {self.sentence(2, 12)}"
            self.leaf(*r.choice([("", text, ""), ("<p>", text, "</p>"), ("<div>", text, "</div>")]), False)
        elif kind in ("ad", "notice"):
            for _ in range(r.randint(1, 2)):
                text = self.text(r.randint(1, 3))
                self.leaf(*r.choice([("", text, ""), ("<p>", text, "</p>"), ("<div><b>", text, "</b></div>")]), False)
                self.out.append("<hr>")
            if kind == "notice" and r.random() < 0.5:
                self.leaf("<button>", self.word(), "</button>", False)
        elif kind == "comments":
            for _ in range(r.randint(1, 6)):
                self.out.append(f'<div class="{r.choice(["comment", "reply", "comment-body"])}">')
                if r.random() < 0.6:
                    self.leaf('<div class="author">', self.word().capitalize(), "</div>", False)
                self.leaf("<p>", self.text(r.randint(1, 4)), "</p>", False)
                self.out.append("</div>")
        elif kind == "form":
            for _ in range(r.randint(1, 3)):
                self.leaf("<div><label>", " ".join(self.word() for _ in range(r.randint(1, 3))), '</label><input name="q"></div>', False)
            self.leaf("<button>", self.word(), "</button>", False)
        elif kind == "aside":
            self.leaf("<p>", self.text(r.randint(1, 2)), "</p>", False)
        self.out.append(f"</{tag}>")

    def article(self, title: str) -> None:
        r = self.r
        kind = r.random()
        tags = ["article"] if kind < 0.5 else ["main", "article"] if kind < 0.6 else ["main"] if kind < 0.7 else ["div"]
        for tag in tags:
            self.out.append(f"<{tag}{self.attribute(_MAIN_NAMES) if tag == 'div' or r.random() < 0.25 else ''}>")
        if r.random() < 0.9:
            self.leaf(r.choice(["<h1>", "<h1>", "<h2>"]), title, "</h1></h2>", True)
        for k in range(r.choice([1, 2, 3, 4, 6, 9, 14, 25])):
            what = r.random()
            text = self.text(r.choice([1, 1, 2, 3, 5, 8]))
            if r.random() < 0.15:
                text = self.sentence(1, 4)
            if r.random() < 0.08:
                text = r.choice([" | ", " · ", " / ", " # ", " ", " © "]).join([self.word() for _ in range(r.randint(2, 12))])
            if r.random() < 0.12:
                text = text.replace(" ", f' <a href="/{self.word()}">{self.word()}</a> ', 1)
            if what < 0.78:
                bold = r.random() < 0.2
                self.leaf("<p>" + "<b>" * bold, text, ("<br>" if bold and r.random() < 0.8 else "</p>"), True)
            elif what < 0.84:
                self.leaf("</p><h2>", self.sentence(1, 6).rstrip("."), "</h2>", True)
            elif what < 0.9:
                self.out.append("</p><ul>")
                for _ in range(r.randint(2, 5)):
                    self.leaf("<li>", self.sentence(2, 12), "</li>", True)
                self.out.append("</ul>")
            elif what < 0.94:
                self.leaf("</p><blockquote>", text, "</blockquote>", True)
            elif what < 0.97:
                self.leaf("</p><div>", text, "</div>", True)
            else:
                self.out.append("</p>")
                self.side(r.choice(["ad", "aside", "notice"]))
        for tag in tags[::-1]:
            self.out.append(f"</{tag}>")

    def page(self) -> tuple[str, list[int]]:
        r = self.r
        title = self.text(1)[: r.choice([30, 60, 90])].strip() + "x"
        self.out.append('<!DOCTYPE html><html><head><meta charset="utf-8">')
        self.leaf("<title>", title, "</title>", False)
        self.out.append(f"</head><body{self.attribute(['page', 'home', 'single']) if r.random() < 0.3 else ''}>")
        wrapped = r.random() < 0.3
        self.out.append('<div class="wrapper">' if wrapped else "")
        for kind, chance in (("notice", 0.2), ("header", 0.5), ("nav", 0.85), ("ad", 0.6), ("form", 0.2), ("aside", 0.15)):
            if r.random() < chance:
                self.side(kind)
        self.article(title)
        for kind, chance in (("ad", 0.2), ("comments", 0.35), ("aside", 0.35), ("form", 0.15), ("nav", 0.15), ("notice", 0.1), ("footer", 0.85)):
            if r.random() < chance:
                self.side(kind)
        self.out.append("</div>" if wrapped else "")
        self.out.append("</body></html>")
        return "".join(self.out), self.labels


def generated(n: int, seed: int) -> tuple[list[Blocks], list[np.ndarray]]:
    """Blocks and labels of n laid-out pages; pages whose blocks don't match their leaves one to one are laid out anew."""
    r, pages, labels = random.Random(seed), [], []
    while len(pages) < n:
        page, truth = _Layout(r).page()
        found = blocks(page)
        if len(found) == len(truth):
            pages.append(found)
            labels.append(np.array(truth, float))
    return pages, labels


def train(pages: int = 1200, epochs: int = 6, batch: int = 24, rate: float = 6e-3, seed: int = 7) -> Labeller:
    """Adam on generated pages, in groups of like length; the rate falls to nothing at the end."""
    data, truth = generated(pages, seed)
    model, r = Labeller.fresh(seed), np.random.default_rng(seed)
    order = sorted(range(pages), key=lambda k: len(data[k]))
    groups = [order[a : a + batch] for a in range(0, pages, batch)]
    ready = [(Pages([data[k] for k in g]), np.concatenate([truth[k] for k in g])) for g in groups]
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    steps, step = epochs * len(groups), 0
    for _ in range(epochs):
        for g in r.permutation(len(groups)):
            step += 1
            for k, d in model.gradient(*ready[g]).items():
                d = np.clip(d, -1, 1)
                first[k] += 0.1 * (d - first[k])
                second[k] += 0.01 * (d * d - second[k])
                model.w[k] -= rate * (1 - step / (steps + 1)) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return model


@lru_cache(1)
def labeller() -> Labeller:
    """The fitted model of this process."""
    return train()


SCHEMA = "page_id long, url string, text string, n_chars long, n_blocks long, n_main long"


def html_extract(pages: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Main text of each page: its blocks labelled so, in page order, joined by an empty line."""
    weights = pages.sparkSession.sparkContext.broadcast({k: v.astype(np.float32) for k, v in labeller().w.items()})

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Labeller(weights.value)
        for batch in batches:
            for i, j, t in runs(texts(batch.column(2))):
                part = batch.slice(i, j - i)
                found = [blocks(page) for page in part.column(2).to_pylist()]
                main = [[text for text, own in zip(page.texts, p) if own >= threshold] for page, p in zip(found, model.label(found))]
                text = ["\n\n".join(x) for x in main]
                cells = {"text": pa.array(text, pa.string()), "n_chars": pa.array(map(len, text), pa.int64()), "n_blocks": pa.array(map(len, found), pa.int64()), "n_main": pa.array(map(len, main), pa.int64())}
                yield pa.RecordBatch.from_pydict({"page_id": part.column(0), "url": part.column(1)} | cells)

    return pages.select("page_id", "url", "html").mapInArrow(run, SCHEMA)
