"""Personal data: fixed patterns, widened by a linear-chain conditional random field.

Base spans come from four patterns with their checks. A CRF over word-shape features adds what the
patterns miss: numbers in local notation, and secrets (keys, tokens, passwords), which have no fixed
pattern. What goes before a word counts as the labelled table teaches it; there is no list of cues.
The field is trained on that small table by exact log-likelihood gradients, and decoded by Viterbi
in numpy for all chains of a batch at once.

Only words with a digit or an `@` can take part in a span; all others are bound to the outside
label. A chain therefore falls apart, exactly, into its runs of such words, and only these are
decoded. An added span must not touch a base span, holds a number of digits that fits its kind, and
never replaces a base span.

Defined cases: null text is empty; spans count code points, end exclusive; kinds may overlap each
other; repeated rows are judged alike; texts of any length are searched whole; of labels that score
alike the first counts; other columns, whatever their names, are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, batches, read, utf8, word_bounds

KINDS = ("email", "ip", "card", "phone")

# Fixed patterns. Written so that matching takes time in proportion to the text: a match never
# starts inside a run of digits whose start has failed.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the fixed patterns by kind, leftmost and without overlap within a kind."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out["email"].append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    for m in _PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out["phone"].append(m.span())
    return out


# ---------------------------------------------------------------- the field

#: Kinds the field may add; a secret (a key, token or password) has no fixed pattern.
FIELD_KINDS = (*KINDS, "secret")
LABELS = ("O", *(f"{p}-{k}" for k in FIELD_KINDS for p in "BI"))
_CORE = re.compile(r"[A-Za-z0-9_+/-]+")


def shape(word: str) -> str:
    """Letters to a or A, runs of digits to 0 (short), 00 (3 or 4) or 000, marks kept; runs collapsed."""
    s = re.sub(r"[0-9]+", lambda m: "0" if len(m[0]) < 3 else "00" if len(m[0]) < 5 else "000", word[:64])
    s = re.sub(r"[^\W\d_A-Z]+", "a", re.sub(r"[A-Z]+", "A", s))
    return re.sub(r"([aA])[aA]+", r"\1", s)[:24]


def core(word: str) -> tuple[int, int]:
    """The longest run of characters that keys are made of."""
    return max((m.span() for m in _CORE.finditer(word)), key=lambda s: s[1] - s[0], default=(0, 0))


def features(words: list[str], i: int, before: str, after: str) -> list[str]:
    w = words[i]
    digits = sum("0" <= c <= "9" for c in w)
    a, z = core(w)
    inner = w[a:z]
    turns = len(re.findall(r"[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])", inner))
    left, right = words[i - 1] if i else before, words[i + 1] if i + 1 < len(words) else after
    return [
        "bias", "s=" + shape(w), f"d={min(digits, 20)}", "@" if "@" in w else "-@", f"edge={w[:1] in '+('}{w[-1:] in '.,;:)'}",
        f"l={min((z - a) // 4, 10)}", f"t={min(turns, 6)}", f"l,t={z - a >= 16},{min(turns, 4)}", f"hex={z - a >= 16 and not re.search('[^0-9a-f]', inner)}", f"q={w[:a][-1:] in ('=', chr(34), chr(39), ':')}",
        "p=" + (shape(left) if re.search("[0-9@]", left) else left.lower().strip(":.,=" + chr(34))[:16]), "pm=" + left[-1:] * (not left[-1:].isalnum()), "n=" + (shape(right) if re.search("[0-9@]", right) else "w"),
    ]


#: The labelled table is written as templates: text with {kind:form} spans. In a form, # is a digit, and
#: hexN, mixN and lowN are N characters of 0-9a-f, of 0-9A-Za-z and of 0-9a-z; ~ is an invented word anywhere.
_TEMPLATES = (
    ("please call {phone:(###) ###-####} after noon", "tel {phone:###-###-####} or fax {phone:###-###-####}", "phone: {phone:### ### ####}", "mobile {phone:+# ### ### ####}", "reach us at {phone:+## ## #### ####} today",
     "call {phone:(###) ### ####} for help", "write to {email:aaa.aa##@mail#.aaaa.com} soon", "contact {email:aaaa@aaaa.org} now", "email {email:a.aaaa@aaa-aa.net}, thanks", "mail {email:aaaa##@aaaa} inside the office",
     "the card {card:#### #### #### ####} was used", "visa {card:################} expires", "card {card:####-####-####-####} is blocked", "account card {card:#### #### #### #### ###}", "from {ip:###.##.##.###} to {ip:##.###.##.#}",
     "server {ip:##.##.##.##:####} is down", "host {ip:###.###.#.##} failed", "ip {ip:##.###.###.##}/## was seen")
    + ('~ ~ secret = "{secret:hex32}" ~ ~', "api_key={secret:mix32} ~", '"password": "{secret:mix20}",', "export ~={secret:mix40}", "~ key: {secret:low24} ~", '~ = "{secret:hex64}"### ~ ~', "auth {secret:mix24} ~", "~ '{secret:hex32}', ~",
       "the secret {secret:low32}. ~ ~", "token: {secret:mix36}", "bearer {secret:mix48} ~", '~ = "{secret:hex48}" ~')
    + ("version #.# of the page", "license version #.#.# applies", "order ###### was sent in ####", "on ####-##-## at ##:## we met", "it cost $## or ##.## in ####", "room ### on page ##", "the years ####-#### were good",
       "invoice ##### and order ########", "about ##,### people and ###,### more", "CC BY-NC #.# license", "a ratio of #.### to ##%", "key AAAA##AAAA###AAAA in text", "in #### there were ### of ## kinds", "chapter # section #.#.# part #",
       "twitter @aaaa said so", "see @aaaa and @aa_aa", "id ############ of ###", "numbers # ## ### #### ##### are not data", "table ## | ## | ## | ##", "build ####.##.## of aaaa#")
    + ("~ ################ ~ ~", "~ ~ ################. ~", "~ #################### ~", "~ ~ ## ~ ####$$$ ~", "~###& ~ ~#", "~ ~-#### ~ x##_##", "img_########_####.jpg ~", "www.~.com/~/####/## ~", "~ h### ~ #rd ##th ##km ~", "~ #~#~ ~ a#b#", "~ = ## ~ = \"####\" ~", "~ aaaa##, ~-##-~ ~")
)


def labelled_table(copies: int = 12, seed: int = 5) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, [(kind, start, end)]): the templates, several times, with digits and letters drawn."""
    rng = np.random.default_rng(seed)
    letters = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    pick = lambda chars, k: "".join(chars[j] for j in rng.integers(0, len(chars), k))
    draw = {"#": lambda: pick(letters[:10], 1), "~": lambda: pick(letters[10:36], int(rng.integers(2, 10)))}

    def fill(s: str) -> str:
        form = re.fullmatch(r"(hex|low|mix)([0-9]+)", s)
        if form:
            return pick(letters[: {"hex": 16, "low": 36, "mix": 62}[form[1]]], int(form[2]))
        return "".join(draw[c]() if c in draw else c for c in s)

    rows = []
    for _ in range(copies):
        for t in _TEMPLATES:
            text, spans = "", []
            for piece in re.split(r"(\{[a-z]+:[^}]*\})", t):
                if piece.startswith("{"):
                    kind, body = piece[1:-1].split(":", 1)
                    value = fill(body)
                    if kind == "card":  # the last digit makes the sum right
                        value = next(v for d in letters[:10] if luhn((v := value[:-1] + d).replace(" ", "").replace("-", "")))
                    spans.append((kind, len(text), len(text) + len(value)))
                    text += value
                else:
                    text += fill(piece)
            rows.append((text, spans))
    return rows


def _runs_of(text: str) -> list[tuple[list[str], list[tuple[int, int]], str, str]]:
    """Runs of words with a digit or @: (words, bounds, word before, word after)."""
    words = [(m[0], m.span()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    out, i = [], 0
    while i < len(words):
        if not _HINT.search(words[i][0]):
            i += 1
            continue
        j = i
        while j < len(words) and _HINT.search(words[j][0]):
            j += 1
        out.append(([w for w, _ in words[i:j]], [b for _, b in words[i:j]], words[i - 1][0] if i else "", words[j][0] if j < len(words) else ""))
        i = j
    return out


@dataclass
class Field:
    index: dict[str, int]
    emit: np.ndarray  # feature, label
    move: np.ndarray  # label, next label
    start: np.ndarray
    stop: np.ndarray

    def scores(self, run) -> np.ndarray:
        words, _, before, after = run
        rows = []
        for i in range(len(words)):
            ids = [self.index[f] for f in features(words, i, before, after) if f in self.index]
            rows.append(self.emit[ids].sum(0))
        return np.array(rows)

    def decode(self, runs: list) -> list[np.ndarray]:
        """Best labels of each run: Viterbi over all runs of about one length at a time."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(runs)
        order = sorted(range(len(runs)), key=lambda i: len(runs[i][0]))
        for lo in range(0, len(order), 512):
            part = order[lo : lo + 512]
            sizes = np.array([len(runs[i][0]) for i in part])
            e = np.zeros((len(part), sizes.max(), len(LABELS)))
            for k, i in enumerate(part):
                e[k, : sizes[k]] = self.scores(runs[i])
            best, back = self.start + e[:, 0], []
            for t in range(1, e.shape[1]):
                through = best[:, :, None] + self.move
                back.append(through.argmax(1))
                best = np.where((t < sizes)[:, None], through.max(1) + e[:, t], best)
            at = (best + self.stop).argmax(1)
            labels = np.zeros((len(part), e.shape[1]), int)
            for t in range(e.shape[1] - 1, -1, -1):
                labels[np.arange(len(part)), t] = at
                if t:
                    at = np.where(t < sizes, back[t - 1][np.arange(len(part)), at], at)
            for k, i in enumerate(part):
                out[i] = labels[k, : sizes[k]]
        return out


_LEGAL = np.array([[not b.startswith("I-") or (a[2:] == b[2:] and a != "O") for b in LABELS] for a in LABELS])


def train_field(rows: list[tuple[str, list[tuple[str, int, int]]]], steps: int = 120, penalty: float = 0.02, rate: float = 0.3) -> Field:
    """Maximum likelihood by forward-backward over padded chains, with Adagrad and an L2 penalty."""
    runs, gold = [], []
    for text, spans in rows:
        for run in _runs_of(text):
            y = np.zeros(len(run[0]), int)
            for kind, s, e in spans:
                inside = [i for i, (a, b) in enumerate(run[1]) if a < e and b > s]
                for k, i in enumerate(inside):
                    y[i] = LABELS.index(("I-" if k else "B-") + kind)
            runs.append(run)
            gold.append(y)
    index: dict[str, int] = {}
    feats = [[[index.setdefault(f, len(index)) for f in features(r[0], i, r[2], r[3])] for i in range(len(r[0]))] for r in runs]
    n, length, width = len(runs), max(map(len, gold)), len(LABELS)
    ids = np.zeros((n, length, len(feats[0][0])), int)
    live, y = np.zeros((n, length), bool), np.zeros((n, length), int)
    for k, f in enumerate(feats):
        ids[k, : len(f)], live[k, : len(f)], y[k, : len(f)] = f, True, gold[k]
    wall = np.where(_LEGAL, 0.0, -1e4)
    begin = np.array([-1e4 if x.startswith("I-") else 0.0 for x in LABELS])
    p = [np.zeros((len(index), width)), np.zeros((width, width)), np.zeros(width), np.zeros(width)]
    grown = [np.full_like(x, 1e-3) for x in p]
    last = live.sum(1) - 1
    rows_ = np.arange(n)
    lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
    for _ in range(steps):
        emit, move, start, stop = p[0], p[1] + wall, p[2] + begin, p[3]
        e = emit[ids].sum(2)
        a, b = np.zeros((n, length, width)), np.zeros((n, length, width))
        a[:, 0] = start + e[:, 0]
        for t in range(1, length):
            a[:, t] = np.where(live[:, t, None], lse(a[:, t - 1][:, :, None] + move, 1) + e[:, t], a[:, t - 1])
        b[rows_, last] = stop
        for t in range(length - 2, -1, -1):
            b[:, t] = np.where((t < last)[:, None], lse(move + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2), b[:, t])
        z = lse(a[rows_, last] + stop, 1)
        q = np.exp(a + b - z[:, None, None]) * live[:, :, None]
        g = [np.zeros_like(x) for x in p]
        d = np.eye(width)[y] * live[:, :, None] - q
        for k in range(ids.shape[2]):
            np.add.at(g[0], ids[:, :, k][live], d[live])
        for t in range(1, length):
            both = live[:, t]
            pair = np.exp(a[both, t - 1][:, :, None] + move + (e[both, t] + b[both, t])[:, None, :] - z[both][:, None, None])
            g[1] -= pair.sum(0)
            np.add.at(g[1], (y[both, t - 1], y[both, t]), 1)
        g[2] = d[:, 0].sum(0)
        g[3] = (np.eye(width)[y[rows_, last]] - q[rows_, last]).sum(0)
        for i in range(4):
            grad = g[i] - penalty * p[i]
            grown[i] += grad * grad
            p[i] += rate * grad / np.sqrt(grown[i])
    return Field(index, p[0], p[1] + wall, p[2] + begin, p[3])


_DIGITS = {"email": (0, 64), "ip": (4, 17), "card": (13, 19), "phone": (7, 15), "secret": (1, 1 << 20)}


def _add_spans(text: str, run, labels: np.ndarray, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int]]:
    out, i, taken = [], 0, [s for v in base.values() for s in v]
    names = [LABELS[k] for k in labels]
    while i < len(names):
        if names[i] == "O":
            i += 1
            continue
        kind, j = names[i][2:], i + 1
        while j < len(names) and names[j] == "I-" + kind:
            j += 1
        s, e = run[1][i][0], run[1][j - 1][1]
        if kind == "secret":
            a, z = core(text[s:e])
            s, e = s + a, s + z
        while e > s and text[e - 1] in ".,;:!?)" and not (text[e - 1] == ")" and "(" in text[s:e]):
            e -= 1
        lo, hi = _DIGITS[kind]
        digits = sum("0" <= c <= "9" for c in text[s:e])
        if e > s and lo <= digits <= hi and (kind != "email" or re.search(r"[^@]@[^@]", text[s:e])) and (kind != "card" or luhn(re.sub("[^0-9]", "", text[s:e]))) and (kind != "secret" or e - s >= 16 and re.search("[A-Za-z]", text[s:e])) and not any(s < y and e > x for x, y in taken):
            out.append((kind, s, e))
        i = j
    return out


_DIGEST = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_secret long, n_spans long"


def find_pii(docs: DataFrame, labelled: list | None = None) -> DataFrame:
    """Per document: doc_id, base counts by kind, base_sha256, spans (base and added), n_added, n_secret (of those
    added) and n_spans (of all)."""
    field = docs.sparkSession.sparkContext.broadcast(train_field(labelled or labelled_table()))  # of fixed size
    empty = hashlib.sha256(b"").hexdigest()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            n = b.num_rows
            counts, shas, spans, (added, secret) = np.zeros((4, n), np.int64), [empty] * n, [""] * n, np.zeros((2, n), np.int64)
            raw, offsets = utf8(b.column(1))
            marked = np.concatenate([[0], np.cumsum(((raw >= 0x30) & (raw <= 0x39)) | (raw == 0x40))])
            rows = np.flatnonzero(marked[offsets[1:]] > marked[offsets[:-1]])
            s, e, doc = word_bounds(raw, offsets, ~SPACES)
            hot = marked[e] > marked[s]
            chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            runs, owner, texts, bases = [], [], {}, {}
            for i in rows.tolist():
                lo, hi = np.searchsorted(doc, [i, i + 1])
                text = raw[offsets[i] : offsets[i + 1]].tobytes().decode()
                texts[i], bases[i] = text, base_spans(text)
                k = np.flatnonzero(hot[lo:hi]) + lo
                cs, ce = chars[s[k]] - chars[offsets[i]], chars[e[k]] - chars[offsets[i]]
                word = lambda j: raw[s[j] : e[j]].tobytes().decode() if lo <= j < hi else ""  # noqa: E731,B023
                for part in np.split(np.arange(len(k)), np.flatnonzero(np.diff(k) > 1) + 1):
                    if len(part):
                        bounds = list(zip(cs[part].tolist(), ce[part].tolist()))
                        runs.append(([text[x:y] for x, y in bounds], bounds, word(int(k[part[0]]) - 1), word(int(k[part[-1]]) + 1)))
                        owner.append(i)
            extra: dict[int, list] = {}
            for i, r, labels in zip(owner, runs, field.value.decode(runs)):
                if labels.any():
                    extra.setdefault(i, []).extend(_add_spans(texts[i], r, labels, bases[i]))
            for i in rows.tolist():
                base = [(k, x, y) for k in KINDS for x, y in bases[i][k]]
                for j, k in enumerate(KINDS):
                    counts[j, i] = len(bases[i][k])
                more = extra.get(i, [])
                added[i], secret[i] = len(more), sum(k == "secret" for k, _, _ in more)
                line = lambda v: ",".join(f"{k}:{x}:{y}" for k, x, y in v)
                if base:
                    shas[i] = hashlib.sha256(line(base).encode()).hexdigest()
                spans[i] = line(sorted([*base, *more], key=lambda v: (FIELD_KINDS.index(v[0]), v[1], v[2])))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, counts), pa.array(shas), pa.array(spans), *map(pa.array, (added, secret, counts.sum(0) + added))], [c.split()[0] for c in _DIGEST.split(", ")])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return src.mapInArrow(run, _DIGEST)


def op2_pii_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read(spark, sf_dir, "documents"))
