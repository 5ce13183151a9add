"""Problem 4: markup residue in blocks.

Method: a recurrent block labeller. The lines of all blocks of a page are its leaf sequence;
each leaf is a vector of its tag path (open elements, environments, fences and line prefix)
and of its words and signs, each sign with what stands beside it, hashed into a fixed number of
places. A bidirectional LSTM in numpy reads the page's leaves in both directions, and every block
is classified from the mean and the largest of its leaves' states: plain, HTML, Markdown, wiki or LaTeX. That
class decides, and names the notation a block is rewritten from.

The tables hold no labels of markup, so the model is fitted on rendered pages (`rendered`): at
most `SAMPLE_PAGES` pages are chosen by a hash of their id; of their blocks without any sign of a
notation some are written in a notation, some get signs that are none (type names, prices, paths,
comparisons, printed numbering and the like) and some stay. Blocks that hold signs themselves are
read as context but teach nothing, but for those labelled code, which are plain by definition.
The model then reads every page whole.

An exact check follows: a block without any sign that a notation needs (`_LEAST`) is none. The check alone would name
numbers, paths and program text; it adds no block.

Null and empty contents are plain, and so are blocks labelled code. Repeated rows of a page give
equal results, counted once.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from html.entities import html5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.sources.tables import table

SAMPLE_PAGES, DENSE = 3000, 0.1
CLASSES = ("plain", "html", "markdown", "wiki", "latex")
WORDS, HASHED, PATHS, LABELS, HIDDEN = 24, 128, 20, 4, 20
INPUT = HASHED + PATHS + LABELS

# Element names of HTML that text carries.
TAGS = "a|abbr|article|aside|b|big|blockquote|body|br|caption|center|cite|code|col|colgroup|dd|del|div|dl|dt|em|figcaption|figure|font|footer|form|h[1-6]|head|header|hr|html|i|img|input|ins|kbd|li|link|main|mark|meta|nav|nobr|ol|option|p|pre|q|ref|references|s|samp|script|section|select|small|span|strike|strong|style|sub|sup|svg|table|tbody|td|textarea|tfoot|th|thead|title|tr|tt|u|ul|var|wbr|nowiki"
COMMENT = re.compile(r"<!--.*?-->|<!DOCTYPE[^>]*>|<!\[CDATA\[", re.S | re.I)


# Leaves and their vectors.

_TOKEN = re.compile(r"</?[A-Za-z][^<>\n]*>|<!--|-->|&#?\w{1,32};|\\[A-Za-z]+|[^\W_]+(?:_[^\W_]+)*|_+|[^\w\s]{1,3}")
_OPEN = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)[^<>]*?(/?)>")
_SIGNS = re.compile(r"[<>{}$\\#*_\[\]|`=&~^']|[+-] ")
_VOID = frozenset("br hr img input meta link col wbr".split())


_NAMES = frozenset(re.sub(r"h\[1-6\]", "h1|h2|h3|h4|h5|h6", TAGS).split("|"))


#: What is told apart from all else, whatever stands beside it: elements, comments, entities and commands; the rest is hashed.
_OWN = ("<>", "<>a", "<?>", "<?>a", "<!--", "-->", "&;", "&?", "\\command")


class _Places(dict):
    """Word, or sign between what stands left and right of it, to its place: words in the first `WORDS`."""

    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[token] = got = self._place(token)
        return got

    def _place(self, token: str) -> int:
        left, token, right = token[:1], token[1:-1], token[-1:]
        if token[0].isalnum():
            return WORDS - 1 if "_" in token else WORDS - 2 if token.isdigit() else zlib.crc32(token.casefold().encode("utf-8", "surrogatepass")) % (WORDS - 2)
        m = re.match(r"<(/?)([A-Za-z][A-Za-z0-9]*)([^<>]*)>$", token)
        if m:
            known = m[2].lower() in _NAMES and (m[2].islower() or m[2].isupper() or m[2][1:].isdigit()) and "@" not in token
            # An element that begins at a word is most often a type.
            token = ("<>" if known else "<?>") + (left if left == "a" and not m[1] else "")
        elif token[0] == "&" and len(token) > 1:
            token = "&;" if token[1] == "#" or token[1:] in html5 else "&?"
        elif token[0] == "\\":
            token = f"{left}\\{'{' if right == '{' else ''}" if token[1:] not in COMMANDS else "\\command"
        elif token not in ("<!--", "-->"):
            token = left + token + right
        if token in _OWN:
            return WORDS + _OWN.index(token)
        return WORDS + len(_OWN) + zlib.crc32(token.encode("utf-8", "surrogatepass")) % (HASHED - WORDS - len(_OWN))


#: Commands of LaTeX that stand without braces.
COMMANDS = frozenset("item times cdot pm le leq ge geq ne neq approx int sum frac sqrt alpha beta gamma ldots hline par noindent newpage maketitle".split())


_PLACES = _Places()


def _beside(c: str) -> str:
    """Kind of a sign's neighbour: blank, kana or Han (written without blanks, so emphasis stands inside words), letter or digit, other."""
    return " " if not c or c.isspace() else "c" if "぀" <= c <= "鿿" else "a" if c.isalnum() else "{" if c == "{" else "."


def _path_place(name: str) -> int:
    return zlib.crc32(name.encode()) % 8


def page_leaves(contents: list[str | None], labels: list[str | None]) -> tuple[list[list[int]], list[list[int]], list[int]]:
    """Of one page: tokens' places and path places of each leaf, and the number of leaves of each block."""
    tokens, paths, sizes = [], [], []
    for text, label in zip(contents, labels):
        kind = HASHED + PATHS + {"code": 0, "table": 1, "formula": 2}.get(label or "", 3)
        stack: list[str] = []
        fenced = env = wiki = False
        lines = [x for x in (text or "").split("\n") if x.strip()] or [""]
        sizes.append(len(lines))
        for line in lines:
            if not _SIGNS.search(line) and not (stack or fenced or env or wiki):
                tokens.append([_PLACES[f" {w} "] for w in line.split() if w[0].isalnum()])
                paths.append([kind])
                continue
            places = []
            for m in _TOKEN.finditer(line):
                w = m[0]
                if w[0].isalnum():
                    places.append(_PLACES[f" {w} "])
                else:
                    i, j = m.span()
                    places.append(_PLACES[_beside(line[i - 1 : i]) + w + _beside(line[j : j + 1])])
            tokens.append(places)
            head = line.lstrip()
            path = {kind}
            fence = head.startswith(("```", "~~~"))
            fenced ^= fence
            wiki = (wiki or head.startswith("{|")) and not head.startswith("|}")
            env = (env or "\\begin{" in line) and "\\end{" not in line
            for close, name, alone in _OPEN.findall(line):
                name = name.lower()
                if name not in _NAMES:
                    continue
                if close:
                    if name in stack:
                        del stack[len(stack) - 1 - stack[::-1].index(name) :]
                elif not alone and name not in _VOID:
                    stack.append(name)
                path.add(HASHED + _path_place(name))
            path.update(HASHED + _path_place(x) for x in stack)
            for place, has in enumerate((fenced or fence, wiki, env, head[:1] == "#" and head.lstrip("#")[:1] == " ", head[:2] == "> ", head[:1] == "|", head[:2] == "==", head[:2] in ("- ", "* ", "+ "), head[:1].isdigit(), head[:1] == "\\", head[:3] == "'''", "$" in head)):
                if has:
                    path.add(HASHED + 8 + place)
            paths.append(list(path))
    return tokens, paths, sizes


def vectors(pages: list[tuple[list, list]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leaves x INPUT, leaves of each page, leaves of each block) of pages of (contents, labels)."""
    tokens, paths, sizes, per_page = [], [], [], []
    for contents, labels in pages:
        t, p, s = page_leaves(contents, labels)
        tokens += t
        paths += p
        sizes += s
        per_page.append(len(t))
    n = len(tokens)
    x = np.bincount(np.repeat(np.arange(n), [len(t) for t in tokens]) * INPUT + np.fromiter((v for t in tokens for v in t), np.int64), minlength=n * INPUT).reshape(n, INPUT).astype(np.float32)
    np.log1p(x, out=x)
    x[:, :WORDS] *= 0.3
    at = np.repeat(np.arange(n), [len(p) for p in paths])
    x[at, np.fromiter((v for p in paths for v in p), np.int64)] = 1
    return x, np.array(per_page, np.int64), np.array(sizes, np.int64)


# The network.


def _steps(lengths: np.ndarray, backward: bool) -> list[np.ndarray]:
    """For each time step the leaves that are read in it; longer pages first, so active ones are a prefix."""
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    active = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")
    return [(starts[:k] + lengths[:k] - 1 - t) if backward else starts[:k] + t for t, k in enumerate(active) if k]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM over leaves, softmax over the mean and the largest states of each block."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"x{d}"] = r.normal(0, 0.15, (INPUT, 4 * HIDDEN)).astype(np.float32)
            self.p[f"h{d}"] = r.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            self.p[f"c{d}"] = np.zeros(4 * HIDDEN, np.float32)
            self.p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1
        self.p["out"] = r.normal(0, 0.15, (4 * HIDDEN, len(CLASSES))).astype(np.float32)
        self.p["bias"] = np.zeros(len(CLASSES), np.float32)

    def _read(self, x: np.ndarray, steps: list[np.ndarray], d: str, keep: bool) -> tuple[np.ndarray, list]:
        pre = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        states, kept = np.zeros((len(x), HIDDEN), np.float32), []
        width = len(steps[0]) if steps else 0
        h, c = np.zeros((width, HIDDEN), np.float32), np.zeros((width, HIDDEN), np.float32)
        for at in steps:
            k = len(at)
            z = pre[at] + h[:k] @ self.p[f"h{d}"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            new = np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            before = c[:k], h[:k]
            c = f * c[:k] + i * new
            tc = np.tanh(c)
            h = o * tc
            states[at] = h
            if keep:
                kept.append((before, i, f, o, new, tc))
        return states, kept

    def _back(self, x: np.ndarray, steps: list[np.ndarray], d: str, kept: list, grad: np.ndarray, g: dict[str, np.ndarray]) -> None:
        width = len(steps[0])
        dh, dc = np.zeros((width, HIDDEN), np.float32), np.zeros((width, HIDDEN), np.float32)
        dz_all = np.zeros((len(x), 4 * HIDDEN), np.float32)
        gh = np.zeros_like(self.p[f"h{d}"])
        for at, ((c0, h0), i, f, o, new, tc) in zip(reversed(steps), reversed(kept)):
            k = len(at)
            a = dh[:k] + grad[at]
            cc = dc[:k] + a * o * (1 - tc * tc)
            dz = np.concatenate([cc * new * i * (1 - i), cc * c0 * f * (1 - f), a * tc * o * (1 - o), cc * i * (1 - new * new)], 1)
            dz_all[at] = dz
            gh += h0.T @ dz
            dh[:k] = dz @ self.p[f"h{d}"].T
            dc[:k] = cc * f
        g[f"h{d}"], g[f"x{d}"], g[f"c{d}"] = gh, x.T @ dz_all, dz_all.sum(0)

    def probabilities(self, x: np.ndarray, pages: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """blocks x classes."""
        if not len(x):
            return np.zeros((0, len(CLASSES)), np.float32)
        both = np.concatenate([self._read(x, _steps(pages, d == "b"), d, False)[0] for d in "fb"], 1)
        return self._classify(both, sizes)[0]

    def _classify(self, both: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        pooled = np.concatenate([np.add.reduceat(both, starts) / sizes[:, None], np.maximum.reduceat(both, starts)], 1)
        z = pooled @ self.p["out"] + self.p["bias"]
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True), pooled

    def _unpool(self, grad: np.ndarray, both: np.ndarray, pooled: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Gradient of the leaves' states from that of the blocks' scores."""
        g = grad @ self.p["out"].T
        mean, most = g[:, : 2 * HIDDEN] / sizes[:, None], g[:, 2 * HIDDEN :]
        return np.repeat(mean, sizes, 0) + np.repeat(most, sizes, 0) * (both == np.repeat(pooled[:, 2 * HIDDEN :], sizes, 0))

    def fit(self, pages: list[tuple[list, list]], targets: list[list[int]], epochs: int = 10, batch: int = 48, rate: float = 0.01, seed: int = 7) -> Labeller:
        r = np.random.default_rng(seed)
        """Targets are places in CLASSES; below 0 a block teaches nothing."""
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        ready = [vectors([p]) for p in pages]
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(pages))
            for at in range(0, len(order), batch):
                own = [k for k in order[at : at + batch] if len(ready[k][2])]
                if not own:
                    continue
                x = np.concatenate([ready[k][0] for k in own])
                lengths, sizes = np.concatenate([ready[k][1] for k in own]), np.concatenate([ready[k][2] for k in own])
                y = np.concatenate([targets[k] for k in own])
                steps = {d: _steps(lengths, d == "b") for d in "fb"}
                read = {d: self._read(x, steps[d], d, True) for d in "fb"}
                both = np.concatenate([read[d][0] for d in "fb"], 1)
                prob, pooled = self._classify(both, sizes)
                known = y >= 0
                prob[np.flatnonzero(known), y[known]] -= 1
                prob[~known] = 0
                prob /= max(known.sum(), 1)
                g = {"out": pooled.T @ prob, "bias": prob.sum(0)}
                back = self._unpool(prob, both, pooled, sizes)
                for k, d in enumerate("fb"):
                    self._back(x, steps[d], d, read[d][1], back[:, k * HIDDEN : (k + 1) * HIDDEN], g)
                step += 1
                norm = float(np.sqrt(sum((v * v).sum() for v in g.values())))
                for k, v in g.items():
                    v = v * min(1.0, 5.0 / (norm + 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.999 * second[k] + 0.001 * v * v
                    self.p[k] -= (rate / (1 + step / 300) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


# Rendering of labelled pages.


def _inside(words: list[str], r: random.Random, around) -> str:
    """The words with `around` made of one to three of them."""
    n = min(r.choice((1, 1, 1, 2, 3)), len(words))
    at = r.randrange(len(words) - n + 1)
    return " ".join([*words[:at], around(" ".join(words[at : at + n])), *words[at + n :]])


def _between(words: list[str], r: random.Random, piece: str) -> str:
    at = r.randint(0, len(words))
    return " ".join([*words[:at], piece, *words[at:]])


def _items(words: list[str], r: random.Random) -> list[str]:
    """The words as two to seven items of one to six words, taken over again where they run out."""
    return [" ".join(words[(k * 3) % len(words) :][: r.randint(1, 6)]) or words[0] for k in range(r.randint(2, 7))]


def _cells(words: list[str], r: random.Random) -> list[list[str]]:
    wide = r.randint(2, 4)
    return [[str(r.randint(1, 9999)) if r.random() < 0.5 else i for i in (_items(words, r) * 2)[:wide]] for _ in range(r.randint(2, 6))]


def _as_html(words: list[str], r: random.Random) -> str:
    text, attributes = " ".join(words), r.choice(("", "", " class=note", ' class="hl"', " align=left", ' id="s2"', " style='x'"))
    name = r.choice(("b", "strong", "i", "em", "span", "u", "sup", "sub", "a href='x.html'", "mark", "code", "font color=red"))
    name = name.upper() if r.random() < 0.15 and "=" not in name else name
    close = name.split()[0]
    mid = r.randint(1, max(1, len(words) - 1))
    kind = r.choice((0, 1, 2, 3, 4, 4, 4, 5, 6, 7, 7, 8, 8, 9, 10, 11))
    if kind < 3:
        return _inside(words, r, lambda w: f"<{name}{attributes if ' ' not in name else ''}>{w}</{close}>")
    if kind == 3:
        return f"<p{attributes}>{text}" + r.choice(("</p>", "", f"</p><p>{text}</p>"))
    if kind == 4:
        return r.choice(("<br>{}", "<br/>{}", "<br />{}", "<BR>{}", "{}<br>")).format(r.choice(("", "\n"))).join([" ".join(words[:mid]), " ".join(words[mid:])])
    if kind == 5:
        o = r.choice(("ul", "ol"))
        return f"<{o}>" + "".join(f"<li>{x}</li>" for x in _items(words, r)) + f"</{o}>"
    if kind == 6:
        rows = "".join("<tr>" + "".join(f"<{t}{r.choice(('', '', ' colspan=2'))}>{c}</{t}>" for c in row for t in [r.choice(("td", "td", "th"))]) + "</tr>" for row in _cells(words, r))
        return r.choice(("<table>{}</table>", "<table border=1>{}</table>", "<table><tbody>{}</tbody></table>")).format(rows)
    if kind == 7:
        return _between(words, r, f"<!-- {words[0]} {r.randint(1, 99)} -->")
    if kind < 10:
        entity = r.choice(("&amp;", "&nbsp;", "&lt;", "&gt;", "&quot;", "&#8226;", "&#x2022;", "&#39;", "&eacute;", "&mdash;", "&copy;", "&hellip;"))
        return r.choice((_between(words, r, entity), _inside(words, r, lambda w: w + entity), _inside(words, r, lambda w: entity.join(w.split()) if " " in w else entity + w)))
    if kind == 10:
        return f'<div{attributes}><p>{text}</p></div>' if r.random() < 0.6 else f"<h{r.randint(1, 6)}>{' '.join(words[:mid])}</h{r.randint(1, 6)}>\n{' '.join(words[mid:])}"
    return r.choice(('<img src="img/{}.png"/> ', "<hr/> ", '<a name="{}"></a>', "<blockquote>{} ")).format(words[0]) + text


def _as_markdown(words: list[str], r: random.Random) -> str:
    text, mid = " ".join(words), r.randint(1, max(1, len(words) - 1))
    kind = r.choice((0, 1, 2, 3, 4, 5, 5, 6, 7, 8, 9, 9, 10, 11))
    if kind < 5:
        mark = r.choice(("**", "*", "***", "__", "~~", "`", "***", "~~"))
        return _inside(words, r, lambda w: f"{mark}{w}{mark}")
    if kind == 5:
        return f"{'#' * r.randint(1, 6)} {' '.join(words[:mid])}\n{r.choice(('', chr(10)))}{' '.join(words[mid:])}"
    if kind == 6:
        return "> " + " ".join(words[:mid]) + r.choice(("\n> ", " ")) + " ".join(words[mid:])
    if kind == 7:
        sign = r.choice(("- ", "* ", "+ ", "- [ ] ", "- [x] "))
        return "\n".join(sign + x for x in _items(words, r))
    if kind == 8:
        rows = ["| " + " | ".join(c) + " |" for c in _cells(words, r)]
        return "\n".join([rows[0], "|" + "|".join(r.choice(("---", ":---", ":--:", " --- ", "---:")) for _ in rows[0].split(" | ")) + "|", *rows[1:]])
    if kind == 9:
        if r.random() < 0.5:
            return f"{text}\n```{r.choice(('', 'c'))}\n{words[0]} = {words[-1].strip('.')}({r.randint(1, 99)})\n```"
        return r.choice(("```{}\n{}\n```", "~~~{}\n{}\n~~~")).format(r.choice(("", "c", "python")), text)
    if kind == 10:
        return r.choice(("![{}](img/{}_12.png)\n", "![{}]({}.jpg) ")).format(" ".join(words[:mid]), words[0]) + text
    return _inside(words, r, lambda w: f"[{w}]({r.choice(('http://a.example/x-1', 'notes.md', '#part'))})") if r.random() < 0.8 else f"{text}\n\n[{words[0]}]: http://a.example/x"


def _as_wiki(words: list[str], r: random.Random) -> str:
    text, mid = " ".join(words), r.randint(1, max(1, len(words) - 1))
    kind = r.randrange(9)
    if kind < 2:
        eq = "=" * r.randint(2, 5)
        return f"{eq} {' '.join(words[:mid])} {eq}\n{' '.join(words[mid:])}"
    if kind < 4:
        return _inside(words, r, lambda w: r.choice((f"[[{words[0]}|{w}]]", f"[[{w}]]"))) + r.choice(("", "", " {{see|" + words[0] + "}}"))
    if kind == 4:
        return _inside(words, r, lambda w: r.choice(("'''{}'''", "''{}''", "'''{}'''")).format(w))
    if kind == 5:
        head = " ".join(words[:mid])
        return f"'''{head}''' {' '.join(words[mid:])}" + r.choice(("", f'<ref name="n{r.randint(1, 9)}">{text}</ref>'))
    if kind == 6:
        return _between(words, r, "{{" + r.choice(("see|", "cite|", "")) + words[0] + "}}")
    if kind == 7:
        return r.choice(('{| class="grid"\n', "{|\n", "{| border=1\n")) + "\n".join("|-\n| " + " || ".join(c) for c in _cells(words, r)) + "\n|}"
    return text + r.choice(("<ref>{}</ref>", '<ref name="a">{}</ref>', "[[Category:{}]]")).format(words[0])


def _formula(r: random.Random) -> str:
    a, b = r.randint(1, 99), r.randint(1, 99)
    return r.choice((
        f"x_{{{a}}} + y = {b}", f"n^{{{a}}} \\geq {b}", f"\\frac{{{a}}}{{{b}}}", f"\\alpha_{a} + \\beta = {b}", f"\\sqrt{{{a} + {b}}} \\neq {b}", f"\\int_0^{{{a}}} f(t)\\,dt \\approx {b}.5", f" {a} \\times {b} ",
        f"\\sum_{{i=1}}^{{{a}}} i = {b}", f"a = {b}", f"x^{a % 9} - {b}", f"{a} \\pm {b}", f"E_{a % 9}",
    ))


def _as_latex(words: list[str], r: random.Random) -> str:
    text, mid = " ".join(words), r.randint(1, max(1, len(words) - 1))
    kind = r.randrange(10)
    if kind < 2:
        name = r.choice(("section", "subsection", "section*", "subsection*", "subsubsection", "chapter", "paragraph"))
        return f"\\{name}{{{' '.join(words[:mid])}}} {' '.join(words[mid:])}" + r.choice(("", f"\\label{{sec:{words[0]}}}"))
    if kind < 5:
        name = r.choice(("textbf", "textit", "emph", "underline", "texttt", "textsc", "footnote"))
        return _inside(words, r, lambda w: f"\\{name}{{{w}}}")
    if kind < 7:
        return _between(words, r, r.choice(("${}$", "${}$", "\\({}\\)")).format(_formula(r)))
    if kind == 7:
        return r.choice(("$$ {} $$", "$${}$$", "\\[ {} \\]", "\\begin{{equation}}\n{}\n\\end{{equation}}", "\\begin{{align}} {} \\end{{align}}")).format(_formula(r))
    if kind == 8:
        o = r.choice(("itemize", "enumerate"))
        return f"\\begin{{{o}}}\n" + "\n".join(f"\\item {x}" for x in _items(words, r)) + f"\\end{{{o}}}"
    return text + r.choice(("~\\cite{{{}}}", " \\ref{{{}}}", "\\label{{{}}}", "~\\ref{{fig:{}}}", "\\footnote{{{}}}")).format(words[0] + str(r.randint(1, 99)))


def _as_plain(words: list[str], r: random.Random, names: list[str]) -> str:
    """The words with signs that are no markup, of which some hold names; or a printed number or numbering alone."""
    a, b, w = r.randint(1, 99), r.randint(1, 99), words[0]
    if r.random() < 0.25:
        return r.choice((f"~ {a} ~", f"- {a} -", f"{a} |", f"[{a}]", f"| {a}", f"~ ix ~", f"{' '.join(words[:5])} | {a}", f"{a}. {' '.join(words[:6])}\n{a + 1}. {' '.join(words[:4])}", f"({a}) {' '.join(words)}", f"- {a} -\n{' '.join(words)}", f"* {a} *", f"[{a}] {' '.join(words)}"))
    w, v = (r.choice(names) if names and r.random() < 0.8 else x.strip(".,;:") or "x" for x in (w, words[-1]))
    upper = w[:1].upper() + w[1:]
    piece = r.choice((
        f"list<{upper}>", f"vector<{upper}>.", f"map<{upper}, {upper}>", f"{w} < {a} and {w} > {b}", f"{a} < {b}", f"{a} > {b} < {a + b}", f"x < {a} and y > {b}", f"<{w}.desk@mail.example>", f"${a} and ${b}.", f"${a}.{b}", f"US${a}", f"C:\\{w}\\{v}", f"C:\\{w}\\{v}", f"C:\\{w}\\new", f"/usr/{w}/x_{a}", f"{w}_{v}_{a}", f"{w}_{a};",
        "C# and F#", "C# and F#", "C#", "R&D", f"A&B {w}", f"item #{a}.", f"#{a}", f"[{a}]", f"[{a}];", f"{w}[{a}]", f"|{w}| + |x|", "|x| + |y|", "|a| - |b|", f"{{{w}, {v}}}", f"{{{w}, {v}}}", f"{{{w}, x}}", f"{{{w}}}", f"{a} * {b} * {w}", f"{a} << {b % 9}", f"{a} << {b % 9}", f"~{a} {w}", f"{a} = {b}", f"{w} = {a};", f"{w}'s '{w}'", f"{w}*", f"* {w}", f"{w} ^ {a}", f"{a}%_", f"{a} & {b}", f"{a}% & {w}", f"${a}", f"Mail <{w}.desk@mail.example>", f"costs ${a} and ${b}", f"|{a}|",
        f"x={a}&y={b}", f"--{w} {a}", f"<{a}>", f"{w} -> {v}", f"`{w}", f"{a}^", f"_{w}", f"{w} ~ {a}", f"{a} + {b} = {a + b}", f"{w}/{a}", f"${w.upper()}", f"https://a.example/{w}-{a}", "<= 5", ">= 7", "!= 0",
    ))
    piece += r.choice(("", "", ".", ";", ","))
    return r.choice((_between(words, r, piece), f"{piece} {' '.join(words)}", f"{' '.join(words)} {piece}"))


# Text written without blanks, and the blanks between its pieces and inline signs.
_DENSE = re.compile("[぀-ヿ㐀-鿿][^ \n]{12}")
_BLANK = re.compile("(?<=[぀-ヿ㐀-鿿。，、]) (?=[*~_`\\[<&$\\\\'{぀-ヿ㐀-鿿。，、])|(?<=[*~_`\\]);$}']) (?=[぀-ヿ㐀-鿿。，、])")


def rendered(pages: list[tuple[list, list]], seed: int = 7) -> tuple[list[tuple[list, list]], list[list[int]]]:
    """(pages, targets): of the blocks without a sign of a notation a part is written in one, another gets signs that are none."""
    r = random.Random(seed)
    writers = ((1, _as_html), (2, _as_markdown), (3, _as_wiki), (4, _as_latex))
    # Names are words of these pages, in Latin letters, whatever the language of the block they come to stand in.
    names = sorted({w for contents, _ in pages[:200] for t in contents for w in (t or "").lower().split() if w.isascii() and w.isalpha() and len(w) > 3})
    out, targets = [], []
    for contents, labels in pages:
        own, want = [], []
        for text, label in zip(contents, labels):
            words = (text or "").split()
            dense = _DENSE.search(text or "") is not None
            if dense:
                words = [x[k : k + 3] for x in words for k in range(0, len(x), 3)]
            if text and (_SIGNS.search(text) or "&" in text):
                own.append(text)
                want.append(0 if label == "code" else -1)
            elif not words or label == "code" or r.random() < (0.15 if dense else 0.4):
                own.append(text)
                want.append(0)
            else:
                if r.random() < (0.55 if dense else 0.65):
                    kind, write = r.choice((*writers, *writers[1:2]) if dense else writers)
                    text = write(words, r)
                else:
                    kind, text = 0, _as_plain(words, r, names)
                own.append(_BLANK.sub("", text) if dense and kind else text)
                want.append(kind)
        out.append((own, labels))
        targets.append(want)
    return out, targets


#: What every notation has at least; a block without any of it holds none, whatever its class.
_LEAST = re.compile(
    rf"</?(?:{TAGS})\b|<!|&(?:#\w+|[A-Za-z]\w+);|\\[A-Za-z]+\*?\s*[{{\[]|\\(?:{'|'.join(sorted(COMMANDS))})(?![A-Za-z])|\\[\[(]|\$[^$\n]*[\\^_={{}}][^$\n]*\$|\$\$|\[\[|\{{\{{|\{{\||'{{2}}|={{2}}|\]\(|\]:\s|\*\S|\S\*|__|~~|`|^\s*#{{1,6}}\s|^\s*>\s|^ *[-*+] .*\n *[-*+] |\|\s*:?-{{2}}",
    re.I | re.M,
)

# Rewriting.

_CELL, _ROW = re.compile(r"</t[dh]\s*>", re.I), re.compile(r"</tr\s*>", re.I)


def _from_html(t: str) -> str:
    t = COMMENT.sub("", t)
    t = re.sub(r"<(h[1-6])\b[^>]*>", lambda m: "\n" + "#" * int(m[1][1]) + " ", t, flags=re.I)
    t = re.sub(r"<li\b[^>]*>", "\n- ", t, flags=re.I)
    t = re.sub(r"<pre\b[^>]*>(?:\s*<code\b[^>]*>)?", "\n```\n", re.sub(r"(?:</code>\s*)?</pre\s*>", "\n```\n", t, flags=re.I), flags=re.I)
    t = _ROW.sub("\n", _CELL.sub(" | ", t))
    t = re.sub(r"\s*\|\s*(?=\n|$)", "", t)
    t = re.sub(r"</(?:p|div|h[1-6]|table|ul|ol|blockquote|section)\s*>|<br\s*/?>|<hr\s*/?>", "\n", t, flags=re.I)
    return html.unescape(re.sub(rf"</?(?:{TAGS})(?:\s[^<>]*|\s*/)?>", "", t, flags=re.I))


def _from_wiki(t: str) -> str:
    t = re.sub(r"<ref[^>]*/>", "", re.sub(r"<ref[^>]*>(.*?)</ref>", r" (\1)", t, flags=re.S))
    t = re.sub(r"\[\[(?:Category|File|Image)[^\]]*\]\]|\{\{[^{}]*\}\}", "", t)
    t = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]", r"\1", t)
    t = re.sub(r"^(={2,6})\s*(.*?)\s*\1\s*$", lambda m: "#" * len(m[1]) + " " + m[2], t, flags=re.M)
    t = re.sub(r"^\{\|.*$|^\|\}\s*$|^\|-.*$", "", t, flags=re.M)
    t = re.sub(r"^[|!]\s*", "", t, flags=re.M).replace(" || ", " | ")
    return _from_html(re.sub(r"'{2,5}", "", t))


def _from_latex(t: str) -> str:
    t = re.sub(r"\\(section|subsection|subsubsection)\*?\{([^{}]*)\}", lambda m: "\n" + "#" * (1 + m[1].count("sub")) + f" {m[2]}\n", t)
    t = re.sub(r"~?\\(?:cite|label|ref|eqref)\*?\{[^{}]*\}", "", t)
    t = re.sub(r"\\(?:textbf|textit|emph|underline|texttt|text|textsc)\{([^{}]*)\}", r"\1", t)
    t = re.sub(r"\\begin\{(equation|align|math|displaymath)\*?\}(.*?)\\end\{\1\*?\}", r"$$\2$$", t, flags=re.S)
    t = re.sub(r"\\\[(.*?)\\\]", r"$$\1$$", re.sub(r"\\\((.*?)\\\)", r"$\1$", t, flags=re.S), flags=re.S)
    t = re.sub(r"^\s*\\item\b\s*", "- ", t, flags=re.M)
    return re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?", "", t)


def _from_markdown(t: str) -> str:
    out, fenced = [], False
    for line in t.split("\n"):
        fenced ^= line.lstrip().startswith("```")
        if not fenced and not line.lstrip().startswith("```"):
            if re.fullmatch(r"\|?(?: *:?-{2,}:? *\|?)+", line.strip() or "x"):
                continue
            line = re.sub(r"!?\[([^\]\n]*)\]\([^()\s]+\)", r"\1", re.sub(r"^ *> ?", "", line))
            line = re.sub(r"(?<![A-Za-z0-9À-ÿ])(\*{1,3}|__|~~)(?!\s)([^*_~\n]+)\1", r"\2", line)
            line = re.sub(r"^\|\s*(.*?)\s*\|\s*$", r"\1", re.sub(r"`([^`\n]+)`", r"\1", line))
        out.append(line)
    return "\n".join(out)


def clean(text: str, kind: str) -> str:
    """Text without the notation; headings (#), list items (-), table rows (|), fenced code and formulas stay."""
    t = {"html": _from_html, "wiki": _from_wiki, "latex": _from_latex, "markdown": _from_markdown}.get(kind, str)(text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", t)).strip() if kind != "plain" else text


# Over tables.


def _contents(pages: DataFrame) -> DataFrame:
    b = F.filter("parsing_res_list", lambda x: x.isNotNull())
    get = lambda f: F.transform(b, lambda x: x[f])
    return pages.select("page_id", get("block_id").alias("ids"), get("block_label").alias("labels"), get("block_content").alias("contents")).where("size(ids) > 0")


def fit(pages: DataFrame, sample: int = SAMPLE_PAGES) -> Labeller:
    """A labeller fitted on `sample` rendered pages (and a fifth more at most) of at most as many pages; those of the smallest hash of their id.

    The share of hashes to take follows from the number of pages, so tasks keep a few pages each
    and the driver gets about `sample` of them, however many tasks there are. Where there are fewer
    pages, they are rendered several times.
    """
    pages = pages.where("page_id IS NOT NULL")
    n = pages.agg(F.approx_count_distinct("page_id")).first()[0]
    few = -(2**63) + int(2**64 * min(1.0, 1.1 * sample / max(n, 1))) - 1
    some = _contents(pages.where(F.xxhash64("page_id") <= few)).select(F.xxhash64("page_id").alias("h"), "contents", "labels").dropDuplicates(["h"])
    data = [(r.contents, r.labels) for r in some.orderBy("h").limit(sample).collect()]
    rounds = [rendered(data, seed) for seed in range(-(-sample // max(len(data), 1)))] if data else []
    pages, targets = [x for r in rounds for x in r[0]][:sample], [x for r in rounds for x in r[1]][:sample]
    # Text without blanks is rare but has forms of its own; its pages are rendered twice more, as far as `DENSE` goes.
    dense = [p for p in data if any(t and _DENSE.search(t) for t in p[0])][: int(DENSE * sample)]
    for seed in (101, 102) if dense else ():
        more = rendered(dense, seed)
        pages, targets = pages + more[0], targets + more[1]
    return Labeller().fit(pages, targets)


def label_blocks(pages: DataFrame, model: Labeller, rewrite: bool = False) -> DataFrame:
    """(page_id, block_id, sure, notation, text): blocks of another class than plain with its probability, and the clean text if asked for."""
    sent = pages.sparkSession.sparkContext.broadcast(model.p)
    source = _contents(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Labeller()
        own.p = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                page, ids, labels, contents = (part.column(k).to_pylist() for k in range(4))
                prob = own.probabilities(*vectors(list(zip(contents, labels))))
                best = prob.argmax(1)
                flat = [(p, i, x, t) for p, own_ids, xs, ts in zip(page, ids, labels, contents) for i, x, t in zip(own_ids, xs, ts)]
                keep = [k for k in np.flatnonzero(best) if flat[k][2] != "code" and flat[k][3] and _LEAST.search(flat[k][3])]
                kinds = [CLASSES[best[k]] for k in keep]
                yield pa.record_batch(
                    [
                        pa.array([flat[k][0] for k in keep], pa.int64()),
                        pa.array([flat[k][1] for k in keep], pa.int32()),
                        pa.array([float(prob[k, best[k]]) for k in keep], pa.float64()),
                        pa.array(kinds, pa.string()),
                        pa.array([clean(flat[k][3], x) if rewrite else None for k, x in zip(keep, kinds)], pa.string()),
                    ],
                    names=["page_id", "block_id", "sure", "notation", "text"],
                )

    return source.mapInArrow(run, "page_id long, block_id int, sure double, notation string, text string")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "layout_pages")
    return label_blocks(pages, fit(pages)).select("page_id", "block_id").distinct()


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean text of every block that holds markup."""
    pages = table(spark, sf_dir, "layout_pages")
    return label_blocks(pages, fit(pages), rewrite=True).select("page_id", "block_id", "notation", "text").distinct()


QUERIES = {"p4_found": p4_found, "p4_clean": p4_clean}
SQL: dict[str, str] = {}
