"""Secret scans: a character convolutional network over every candidate and its context.

Candidates are the base findings (assignments, access keys, long hex runs), every
run of `MIN_RUN` or more token characters outside of those, and runs of `SHORT_RUN`
or more that begin within `CUE_REACH` characters after a cue word on its line. The
network reads the whole candidate, in overlapping pieces where it is long, with the
characters around it: character embeddings, one convolution, maximum and mean
pooling, a logistic output. It is trained in numpy on labelled findings that
`labelled_findings` generates from a seed, and calibrated by Platt scaling on
findings of another seed and another mix of shapes; the threshold is the largest
that keeps `MIN_RECALL` of those secrets.

Base findings always stay, as the contract asks; about every other candidate the
network decides, and those above the threshold are added as kind "cnn". Every span
carries its calibrated score.

Defined results: null and empty texts have no spans; repeated rows are each
reported; null ids are kept; offsets are code points, ends exclusive. Time is linear
in a text's length and its candidates.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelstone.llm.common import longs, map_slices, parts
from keelstone.llm.pii import mask
from keelstone.session import prepare

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "cnn")
MIN_RUN, SHORT_RUN, CUE_REACH = 16, 8, 24
MIN_RECALL = 0.97
CONTEXT = 20
PIECE = 64
WIDTH = CONTEXT + PIECE + CONTEXT
STRIDE = 48
EMBED, FILTERS, KERNEL = 8, 24, 5
#: Labelled findings that are generated for training, and half as many for calibration.
FINDINGS = 5000
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: Parts, in lower case, of which a text has one at least if the pattern can match.
_ASSIGN_PARTS = ("passw", "secret", "token", "apikey", "api_key")
_CUE_PARTS = ("passw", "passphrase", "pwd", "secret", "token", "key", "credential", "bearer", "authorization")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_HEX_LONG = re.compile(r"[0-9a-f]{24}")
_RUN = re.compile(r"[A-Za-z0-9+/_=.-]{%d,}" % MIN_RUN)
_RUN_START = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]|\n")
_ANY_RUN = re.compile(r"[A-Za-z0-9+/_=.-]+")
_CUE = re.compile(r"(?ai:passw(?:or)?d|passphrase|pwd|secret|token|(?:api|access|private|licen[cs]e)[_ -]?key|credentials?|bearer|authorization)")


def base_findings(text: str) -> list[tuple[str, int, int]]:
    """The base matches, by kind: leftmost, non-overlapping, failing ones dropped."""
    out = []
    low = text.lower()
    if any(p in low for p in _ASSIGN_PARTS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    at = 0
    while m := _HEX_LONG.search(text, at):  # the first 24 of a run; the run is the whole match
        at = _HEX.match(text, m.start()).end()
        out.append(("hex", m.start(), at))
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Base findings, and the runs of token characters outside of them that the network is to judge,
    trimmed of end marks."""
    base = base_findings(text)
    out = list(base)
    spans = merged([(x, y) for _, x, y in base])
    for a, b, least in _runs(text):
        for a, b in _outside(a, b, spans):
            while b > a and text[b - 1] in ".-_":
                b -= 1
            while a < b and text[a] in ".-_=":
                a += 1
            if b - a >= least:
                out.append(("cnn", a, b))
    return out


def _runs(text: str):
    """(start, end, least length) of each long run, and of the shorter ones that a cue announces."""
    for m in _RUN.finditer(text):
        yield *m.span(), MIN_RUN
    seen, low = 0, text.lower()
    for cue in _CUE.finditer(text) if any(p in low for p in _CUE_PARTS) else ():
        at = max(cue.end(), seen)
        while (m := _RUN_START.search(text, at, cue.end() + CUE_REACH)) and m[0] != "\n":
            run = _ANY_RUN.match(text, m.start())
            at = seen = run.end()
            if SHORT_RUN <= run.end() - run.start() < MIN_RUN:
                yield *run.span(), SHORT_RUN


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping spans as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _outside(a: int, b: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of a to b that no span covers; spans are those of merged()."""
    out = []
    at = max(0, bisect_right(spans, (a, a)) - 1)
    while at < len(spans) and spans[at][0] < b:
        x, y = spans[at]
        if a < x:
            out.append((a, x))
        a = max(a, y)
        at += 1
    return [*out, (a, b)] if a < b else out


def codes(text: str) -> np.ndarray:
    """One printable ASCII byte a character, blanks for all others."""
    c = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
    return np.where((c < 32) | (c > 126), 32, c).astype(np.uint8)


def encode(text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Character codes of the spans' pieces with context, (pieces, WIDTH) bytes, and how many
    pieces each span has. Inside characters are told from outside ones by 128; places
    before and after the text, and after the right context, are 0."""
    starts = [np.arange(a, max(a + 1, b - (PIECE - STRIDE)), STRIDE) for a, b in spans]
    sizes = np.array([len(x) for x in starts])
    at = np.concatenate(starts)
    stop = np.minimum(np.repeat([b for _, b in spans], sizes), at + PIECE)
    place = at[:, None] - CONTEXT + np.arange(WIDTH)
    known = (place >= 0) & (place < np.minimum(stop + CONTEXT, len(text))[:, None])
    rows = np.where(known, codes(text)[np.clip(place, 0, len(text) - 1)], 0).astype(np.uint8)
    inside = (place >= at[:, None]) & (place < stop[:, None])
    return rows | (inside * np.uint8(128)), sizes


class Network:
    """Embedding, convolution, pooling and a logistic output, with its calibration."""

    def __init__(self, seed: int = 7):
        g = np.random.default_rng(seed)
        self.p = {
            "E": g.normal(0, 0.3, (256, EMBED)).astype(np.float32),
            "W": (g.normal(0, 1, (KERNEL * EMBED, FILTERS)) / np.sqrt(KERNEL * EMBED)).astype(np.float32),
            "b": np.zeros(FILTERS, np.float32),
            "V": g.normal(0, 0.2, 2 * FILTERS).astype(np.float32),
            "c": np.zeros(1, np.float32),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray):
        p = self.p
        e = p["E"][x]
        win = np.lib.stride_tricks.sliding_window_view(e, KERNEL, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, KERNEL * EMBED)
        h = np.maximum(win @ p["W"] + p["b"], 0)
        inside = (x[:, KERNEL // 2 : WIDTH - KERNEL // 2] >= 128).astype(np.float32)
        share = inside / np.maximum(inside.sum(1, keepdims=True), 1)
        pooled = np.concatenate([h.max(1), np.einsum("nt,ntf->nf", share, h)], 1)
        return win, h, share, pooled, pooled @ p["V"] + p["c"][0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 256])[-1] for i in range(0, len(x), 256)]) if len(x) else np.zeros(0)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 5, rate: float = 4e-3, seed: int = 11) -> None:
        g, p = np.random.default_rng(seed), self.p
        m, v = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = g.permutation(len(x))
            for i in range(0, len(x), 64):
                at = order[i : i + 64]
                win, h, share, pooled, z = self._forward(x[at])
                d = ((1 / (1 + np.exp(-z)) - y[at]) / len(at)).astype(np.float32)
                dp = d[:, None] * p["V"]
                dh = share[:, :, None] * dp[:, None, FILTERS:]
                top = h.argmax(1)
                np.add.at(dh, (np.arange(len(at))[:, None], top, np.arange(FILTERS)), dp[:, :FILTERS])
                dh *= h > 0
                dwin = dh @ p["W"].T
                dE = np.zeros_like(p["E"])
                for k in range(KERNEL):
                    np.add.at(dE, x[at][:, k : k + h.shape[1]], dwin[:, :, k * EMBED : (k + 1) * EMBED])
                grads = {"E": dE, "W": np.einsum("ntk,ntf->kf", win, dh), "b": dh.sum((0, 1)), "V": pooled.T @ d, "c": d.sum(keepdims=True)}
                step += 1
                for k, w in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * w
                    v[k] = 0.999 * v[k] + 0.001 * w * w
                    p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, z: np.ndarray, y: np.ndarray, min_recall: float = MIN_RECALL) -> None:
        """Platt scaling by Newton steps, then the largest threshold with the recall asked for."""
        n1, n0 = y.sum(), (1 - y).sum()
        goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))  # smoothed, so that separable findings keep finite scores
        w = np.array([0.1, 0.0])
        for _ in range(100):
            q = 1 / (1 + np.exp(-np.clip(w[0] * z + w[1], -30, 30)))
            r = q * (1 - q) + 1e-3
            f = np.stack([z, np.ones_like(z)], 1)
            w = w - np.linalg.solve((f * r[:, None]).T @ f + np.eye(2), f.T @ (q - goal))
        self.scale, self.shift = map(float, w)
        good = np.sort(self.chance(z[y == 1]))
        self.threshold = float(good[int(np.floor((1 - min_recall) * len(good)))])

    def chance(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))


_WORDS = "time year people way day man thing woman life child world school state family student group country problem hand part place case week company system program question work government number night point home water room mother area money story fact month lot right study book eye job word business issue side kind head house service friend father power hour game line end member law car city community name president team minute idea body information".split()
_LOWER, _UPPER, _NUM = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def labelled_findings(n: int = FINDINGS, seed: int = 42, other: bool = False) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): keys of common shapes and look-alikes, in prose, logs, settings
    and code. `other` mixes in shapes that the plain set does not have."""
    g = np.random.default_rng(seed)
    pick = lambda seq: seq[int(g.integers(len(seq)))]
    chars = lambda seq, a, b: "".join(pick(seq) for _ in range(int(g.integers(a, b + 1))))
    word = lambda: pick(_WORDS)
    syllable = lambda: pick("bcdfghklmnprstvwz") + pick(("a", "e", "i", "o", "u", "ea", "ou")) + pick(("", "", "n", "r", "s", "t", "nd", "st"))
    invented = lambda: "".join(syllable() for _ in range(int(g.integers(5, 11))))
    foreign = lambda: "".join(pick(("é", "ß", "ción", "ü", "è", "ñ", "ê", "st", "der", "que")) for _ in range(int(g.integers(2, 5))))
    mixed = _LOWER + _UPPER + _NUM
    numeral = lambda: chars("123456789", 1, 1) + chars(_NUM, 0, 2)

    def short():
        """A password of 8 to 15 characters: letters of both cases or a word, and digits."""
        return pick((lambda: pick(_UPPER) + chars(mixed, 5, 11) + chars(_NUM, 2, 3), lambda: word().capitalize()[:7] + chars(_NUM, 3, 4) + chars(mixed, 2, 3), lambda: chars(_LOWER + _NUM, 5, 10) + chars(_NUM, 3, 4)))()

    secret = [
        lambda: chars("0123456789abcdef", 24, 64),
        lambda: chars("0123456789ABCDEF", 20, 48),
        lambda: chars("0123456789abcdefABCDEF", 20, 40),
        lambda: chars(mixed, 18, 64),
        lambda: chars(mixed + "+/", 24, 86) + pick(("", "=", "==")),
        lambda: "AKIA" + chars(_UPPER + _NUM, 16, 16),
        lambda: pick(("ghp_", "gho_", "sk_live_", "rk_test_", "xoxb-", "pk_", "glpat-", "npm_")) + chars(mixed, 20, 40),
        lambda: "eyJ" + chars(mixed, 17, 40) + "." + chars(mixed + "_-", 20, 60),
        lambda: chars(_LOWER + _NUM, 22, 48),
        lambda: "-".join(chars(_UPPER + _NUM, 5, 5) for _ in range(int(g.integers(4, 6)))),
    ]
    plain = [
        lambda: invented(),
        lambda: invented().upper(),
        lambda: invented().capitalize(),
        lambda: "".join(word().capitalize() for _ in range(4)),
        lambda: pick((word(), "get", "set", "on")) + "".join(word().capitalize() for _ in range(3)) + pick(("", "2", "V3", "Id", "Url")),
        lambda: pick("_-").join(word() for _ in range(4)) + pick(("", "_2", "-v2", "_" + chars(_NUM, 2, 4))),
        lambda: "/" + "/".join(word() for _ in range(4)) + pick(("", ".py", ".html", ".txt")),
        lambda: ".".join([word(), word(), "example", pick(("com", "org", "net")), word()]),
        lambda: f"20{chars(_NUM, 2, 2)}-{chars('01', 2, 2)}-{chars('012', 2, 2)}T{chars('01', 2, 2)}",
        lambda: chars(_LOWER, 16, 40),
        lambda: chars(_UPPER, 16, 40),
        lambda: chars(_NUM, 16, 24),
        lambda: chars(_NUM, 16, 16),
        lambda: pick(("-", ".")).join(chars(_NUM, 3, 4) for _ in range(int(g.integers(4, 7)))),
        lambda: pick("=-_.+/") * int(g.integers(16, 40)) + word(),
        lambda: f"{word()}.{word()}.{chars(_NUM, 1, 2)}.{word()}{chars(_NUM, 1, 2)}",
        lambda: f"v{numeral()}.{numeral()}.{numeral()}-{word()}-{word()}",
        lambda: f"{word()}={word()}+{word()}/{word()}{chars(_NUM, 1, 2)}",
        lambda: pick(("aaaaaaaa", "hahaha", "abababab", "ooooooo")) * 3,
        lambda: invented() + "." + word() + chars(_NUM, 1, 2),
        lambda: f"{chars(_NUM, 2, 2)}@mail{numeral()}.example.com {word()}"[3:],
    ]
    if other:
        secret += [
            lambda: chars(_UPPER + "234567", 24, 32),
            lambda: chars(mixed + "-_", 32, 43),
            lambda: chars("0123456789abcdef", 8, 8) + "." + chars(mixed, 16, 24),
            lambda: "SG." + chars(mixed + "_-", 22, 22) + "." + chars(mixed + "_-", 30, 43),
        ] * 2
        plain += [
            lambda: f"{word()}_{word()}_20{chars(_NUM, 2, 2)}{chars(_NUM, 4, 4)}.{pick(('csv', 'parquet', 'log', 'jpg'))}",
            lambda: f"{word()}-{word()}.{word()}.internal.{pick(('com', 'net'))}/{word()}",
            lambda: f"{chars(_NUM, 4, 5)}/{chars(_NUM, 6, 8)}-{chars(_NUM, 2, 4)}",
            lambda: f"{invented()}-{invented()}",
            lambda: f"{word().capitalize()}{word().capitalize()}Exception.{word()}",
        ] * 2
    hint = ('token = "', "secret: ", "api_key=", "Authorization: Bearer ", "password: ", "export KEY=", "key ", "credentials ", 'auth="')
    cue = ("password", "passwd", "pwd", "secret", "token", "api key", "access key", "passphrase", "credentials", "Bearer", "private key", "Password", "API key", "license key")
    link = (" ", " is ", " was ", ": ", " -> ", " (", ' "', " for it: ", "\t", " now ")
    out = []
    for i in range(n):
        label = i % 2
        prose = lambda k: " ".join(pick((invented, word, word, foreign))() for _ in range(k))
        left = pick((lambda: prose(6) + pick((" ", "\n", ". ")), lambda: f"{chars(_NUM, 2, 2)}:{chars(_NUM, 2, 2)} INFO {word()}: ", lambda: f"{word()}_{word()}: {numeral()}\n", lambda: f"def {word()}({word()}):\n    "))()
        if g.random() < 0.2:  # runs that only a cue makes candidates
            body = short() if label else pick((lambda: invented()[:13], lambda: word() + pick(("", "s")) + word()[:6], lambda: word().capitalize() + word()[:7], lambda: word() + "-" + word()[:6], lambda: f"20{chars(_NUM, 2, 2)}-{chars('01', 2, 2)}-{chars('012', 2, 2)}", lambda: chars(_NUM, 8, 10)))()
            body = (body + chars(_LOWER, 8, 8) if len(body) < SHORT_RUN else body)[: MIN_RUN - 1]
            left += pick(cue) + pick(link)
        else:
            body = pick(secret if label else plain)()
            chance = g.random()
            if chance < (0.5 if label else 0.12):
                left += pick(hint)
            elif chance < (0.6 if label else 0.3):
                left += pick(('"', "(", "'", "| ", "<", "$$$ ", "https://", "id="))
        out.append((left + body + pick((" ", " ", '" ', ", ", ". ", "\n", ") ", "!! ", "### ")) + prose(5), len(left), len(left) + len(body), label))
    return out


def _encoded(found: list[tuple[str, int, int, int]]) -> tuple[list[np.ndarray], np.ndarray]:
    return [encode(t, [(a, b)])[0] for t, a, b, _ in found], np.array([f[3] for f in found], np.float32)


@lru_cache(maxsize=2)
def trained(n: int = FINDINGS, seed: int = 42) -> Network:
    """The network, trained on one set of findings and calibrated on another one."""
    x, y = _encoded(labelled_findings(n, seed))
    net = Network()
    net.fit(np.concatenate(x), np.concatenate([np.full(len(r), v, np.float32) for r, v in zip(x, y)]))
    held, z = _encoded(labelled_findings(n // 2, seed + 1000, other=True))
    net.calibrate(np.array([net.logits(r).max() for r in held], float), z.astype(float))
    return net


def find_all(net: Network, texts: list[str | None]) -> list[list[tuple[str, int, int, float]]]:
    """(kind, start, end, score) of each text's spans, by start and then kind; one
    forward pass takes the candidates of all texts given."""
    owner, cand, rows, sizes = [], [], [], []
    for i, t in enumerate(texts):
        if t and (c := candidates(t)):
            r, n = encode(t, [(a, b) for _, a, b in c])
            owner += [i] * len(c)
            cand += c
            rows.append(r)
            sizes.append(n)
    out: list[list] = [[] for _ in texts]
    if cand:
        z = net.logits(np.concatenate(rows))
        score = net.chance(np.maximum.reduceat(z, np.concatenate([[0], np.cumsum(np.concatenate(sizes))[:-1]])))
        for i, (kind, a, b), s in zip(owner, cand, score.tolist()):
            if kind != "cnn" or s >= net.threshold:
                out[i].append((kind, a, b, s))
    for o in out:
        o.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return out


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def scan(docs: DataFrame, net: Network | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, found): kind, start, end and score of each span, in order."""
    shipped = prepare(docs.sparkSession).sparkContext.broadcast(net or trained())

    def work():
        net = shipped.value

        def fn(ids, texts):
            found = find_all(net, texts)
            return [longs(ids), pa.array([[dict(zip(("kind", "start", "end", "score"), s)) for s in f] for f in found], _SPANS)]

        return fn

    return map_slices(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), work, "doc_id bigint, found array<struct<kind:string,start:bigint,end:bigint,score:double>>")


def redact(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """The documents with every secret in `text` masked; n_chars, where there is
    such a column, follows the new text; other columns stay."""
    shipped = prepare(docs.sparkSession).sparkContext.broadcast(net or trained())
    at = docs.columns.index("text")

    def run(batches):
        net = shipped.value
        for b in batches:
            for part in parts(b):
                texts = part.column(at).to_pylist()
                new = [t if not f else mask(t, [s[:3] for s in f], "[SECRET]") for t, f in zip(texts, find_all(net, texts))]
                yield part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)
    return out
