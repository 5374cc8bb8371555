"""Personal data: patterns first, then a linear-chain conditional random field.

The base patterns find e-mail and IP addresses, card and phone numbers; their spans
always stay. They miss what touches another number: a phone number followed by a card
number is one run too long for either. The CRF reads tokens instead: word-shape
features of a token and its neighbours, first-order transitions between labels, weights
trained here by maximum likelihood on a small labelled table, decoding by Viterbi in
numpy over batches of sequences. A decoded span is added where no base span lies.

A token without digit, "@" or "+" has the label O by definition, so a text falls apart
into short chains between such tokens; each is decoded exactly, all chains of a length
at once, and plain prose costs one scan.

Spans count code points, end exclusive, in order of start, then kind.

Defined cases: a null text is an empty one and has no span; very long texts and long
runs of digits or letters are scanned in linear time; repeated rows and null ids give
rows of their own; an empty table gives no rows; further columns are passed through.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tabscope.llm.common import doc_with_text, map_columns, texts

#: Fixed values of the contract: kinds in order, and what their patterns allow.
KINDS = ("email", "ip", "card", "phone")
EMAIL_NAME = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Only at the start of a run of digits: later starts in a run fail where the first does.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

LABELS = ("O", *(f"{part}-{kind}" for kind in KINDS for part in "BI"))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches without overlap, in linear time: from each "@" outwards."""
    end, at, last = 0, text.find("@"), -1
    while at >= 0:
        low = max(end, last + 1)
        name = text[low:at]
        start = low + len(name.rstrip(EMAIL_NAME))
        domain = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            end = domain.end()
        last = at
        at = text.find("@", max(at + 1, end))


def _ip_ok(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def _card_ok(text: str) -> bool:
    digits = NOT_DIGIT.sub("", text)
    return 12 <= len(digits) <= 19 and luhn(digits)


def _phone_ok(text: str) -> bool:
    return 9 <= len(NOT_DIGIT.sub("", text)) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns; failing matches are dropped."""
    found = [(s, 0, e) for s, e in emails(text)]
    for kind, pattern, ok in ((1, IP, _ip_ok), (2, CARD, _card_ok), (3, PHONE, _phone_ok)):
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if ok(m.group())]
    return sorted(found)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


# ---- tokens and features

#: A token that may belong to personal data: one look at each token, however long.
CANDIDATE = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@+]*+[0-9@+][^\x20\x09-\x0D]*")
#: Longer tokens are left to the base patterns.
MOST_CHARS = 64
#: Marks around a token that are not part of it.
LEFT, RIGHT = "\"'<[{,;:=`", "\"'>]},;:!?`."


def chains(text: str) -> list[list[tuple[str, int, int]]]:
    """Maximal runs of neighbouring candidate tokens, as (core, start, end)."""
    out, last = [], None
    for m in CANDIDATE.finditer(text):
        raw = m.group()
        core = raw.lstrip(LEFT)
        start = m.start() + len(raw) - len(core)
        core = core.rstrip(RIGHT)
        if not core or len(core) > MOST_CHARS:
            continue
        token = (core, start, start + len(core))
        # neighbours: only one to three separators between them
        if last is not None and m.start() - last <= 3 and not text[last : m.start()].strip(" \t\n\v\f\r"):
            out[-1].append(token)
        else:
            out.append([token])
        last = m.end()
    return out


def shape(core: str) -> str:
    """The token with runs of letters as a, of digits as 9 and their number."""
    s = re.sub(r"[A-Z]+", "A", re.sub(r"[a-zß-ÿ]+", "a", core))
    return re.sub(r"[0-9]+", lambda m: f"9{min(len(m.group()), 20)}", s)[:40]


def token_features(core: str) -> list[str]:
    digits = NOT_DIGIT.sub("", core)
    out = [f"n{min(len(digits), 20)}", f"p{core[0] if not core[0].isalnum() else 'w'}"]
    if "@" in core:
        name, _, domain = core.partition("@")
        out.append("at" if name and "." in domain.strip(".") and "@" not in domain else "@")
    plain = all(c in "0123456789-.()+" for c in core)
    out.append("plain" if plain else "mixed")
    if core.isdigit():
        out.append("run")
        if 12 <= len(digits) <= 19:
            out.append("luhn" if luhn(digits) else "notluhn")
    if plain and core.count(".") == 3 and all(p.isdigit() and int(p[:4]) <= 255 for p in core.split(".")):
        out.append("quad")
    if not digits and "@" not in core:
        out.append("nodigit")
    s = shape(core)
    return out + [f"s{s}"] if len(s) <= 16 else out


def features(chain: list[str]) -> list[list[str]]:
    """Features of each token: its own, and the shapes of its neighbours."""
    own = [token_features(c) for c in chain]
    shapes = [shape(c)[:12] for c in chain]
    return [
        f + [f"<{shapes[i - 1] if i else ''}", f">{shapes[i + 1] if i + 1 < len(chain) else ''}", "1"]
        for i, f in enumerate(own)
    ]


# ---- the labelled table


def labelled_table(rows: int = 600, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """(tokens, labels): chains in many layouts, alone and side by side.

    The contract of the labels is in the generators: what an e-mail address, an IP
    address, a card and a phone number look like, and what numbers and codes do not.
    """
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))

    def card() -> list[str]:
        body = rng.choice("3456") + digits(rng.choice((14, 14, 14, 13)))
        number = next(body + c for c in "0123456789" if luhn(body + c))
        if rng.random() < 0.25:
            cut = [number[i : i + 4] for i in range(0, len(number), 4)]
            return ["-".join(cut)] if rng.random() < 0.5 else cut
        return [number]

    def phone() -> list[str]:
        a, b, c, code = digits(3), digits(3), digits(4), rng.choice(("1", "44", "49", "33", "34"))
        return rng.choice(
            (
                [f"+{code}", f"({a})", f"{b}-{c}"],
                [f"+{code}", f"({a})", f"{b}-{c}"],
                [f"+{code}-{a}-{b}-{c}"],
                [f"+{code}", a, b, c],
                [f"+{code}", f"{a}-{b}-{c}"],
                [f"+{code}.{a}.{b}.{c}"],
                [f"+{code}{a}{b}{c}"],
            )
        )

    def email() -> list[str]:
        name = letters(rng.randint(3, 9)) + rng.choice(("", ".", "_")) + digits(rng.choice((0, 2, 2)))
        return [f"{name.strip('._') or 'me'}@{letters(5)}{rng.choice(('', digits(1)))}.{rng.choice(('com', 'org', 'example.com', 'net'))}"]

    def ip() -> list[str]:
        return [".".join(str(rng.randint(0, 255)) for _ in range(4))]

    def other() -> list[str]:
        def bad_card() -> str:
            number = digits(16)
            return number if not luhn(number) else number[:-1] + str((int(number[-1]) + 1) % 10)

        return [
            rng.choice(
                (
                    digits(rng.randint(1, 11)),
                    digits(rng.choice((12, 14, 15, 20, 22, 24))) if rng.random() < 0.2 else bad_card(),
                    f"{digits(1)}.{digits(1)}",
                    f"{digits(1)}.{digits(1)}.{digits(1)}",
                    f"{digits(4)}-{digits(2)}-{digits(2)}",
                    f"{letters(3)}{digits(3)}",
                    f"AKIA{letters(8).upper()}{digits(4)}",
                    f"password={letters(2)}{digits(5)}{letters(2)}{digits(4)}",
                    f"{letters(2)}{digits(6)}{letters(2)}{digits(8)}{letters(1)}",
                    f"@{letters(5)}",
                    f"{letters(3)}+{letters(3)}",
                    "+",
                    f"{digits(3)}.{digits(3)}.{digits(3)}.{int(digits(2)) + 300}",
                    f"{digits(2)}:{digits(2)}",
                    f"{digits(3)}-{digits(4)}",
                )
            )
        ]

    makers = {"email": email, "ip": ip, "card": card, "phone": phone, "O": other}
    out = []
    for _ in range(rows):
        tokens, labels = [], []
        for _ in range(rng.choice((1, 1, 2, 2, 3))):
            kind = rng.choice(("email", "ip", "card", "phone", "card", "phone", "O", "O"))
            new = makers[kind]()
            if kind == "O" and labels and labels[-1] != "O" and new[0][0].isdigit():
                new = [f"{letters(4)}{new[0]}"]  # a bare number next to a number would be ambiguous
            tokens += new
            labels += ["O"] if kind == "O" else [f"B-{kind}", *[f"I-{kind}"] * (len(new) - 1)]
        out.append((tokens, labels))
    return out


# ---- the model


class Crf:
    """Weights of features by label, and of label pairs."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.index, self.emit, self.move = index, emit, move

    def scores(self, chain: list[str]) -> np.ndarray:
        rows = [[self.index[f] for f in fs if f in self.index] for fs in features(chain)]
        return np.stack([self.emit[r].sum(axis=0) for r in rows])

    def decode(self, batch: list[list[str]]) -> list[list[int]]:
        """Best label path of each chain: Viterbi over all chains of one length at once."""
        out: list = [None] * len(batch)
        by_length = defaultdict(list)
        for i, chain in enumerate(batch):
            by_length[len(chain)].append(i)
        for length, members in by_length.items():
            for part in range(0, len(members), 1024):
                rows = members[part : part + 1024]
                scores = np.stack([self.scores(batch[i]) for i in rows])
                best, back = scores[:, 0] + START, []
                for t in range(1, length):
                    paths = best[:, :, None] + self.move + ALLOWED
                    back.append(paths.argmax(axis=1))
                    best = paths.max(axis=1) + scores[:, t]
                path = [best.argmax(axis=1)]
                for b in reversed(back):
                    path.append(b[np.arange(len(rows)), path[-1]])
                for i, labels in zip(rows, np.stack(path[::-1], axis=1).tolist()):
                    out[i] = labels
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


#: I-kind follows only B-kind or I-kind, and starts no chain.
_FORBIDDEN = -1e4
ALLOWED = np.array(
    [[_FORBIDDEN if b[0] == "I" and a[1:] != b[1:] else 0.0 for b in LABELS] for a in LABELS]
)
START = np.array([_FORBIDDEN if x[0] == "I" else 0.0 for x in LABELS])


def train(table: list[tuple[list[str], list[str]]], steps: int = 150, rate: float = 0.3, l2: float = 1e-3) -> Crf:
    """Maximum likelihood by full-batch AdaGrad; forward-backward over chains of one length at once."""
    index: dict[str, int] = {}
    groups = defaultdict(list)
    for tokens, labels in table:
        rows = [[index.setdefault(f, len(index)) for f in fs] for fs in features(tokens)]
        groups[len(tokens)].append((rows, [LABELS.index(x) for x in labels]))
    batches = []
    for length, members in groups.items():
        at = [(m, t, f) for m, (rows, _) in enumerate(members) for t, fs in enumerate(rows) for f in fs]
        batches.append((length, np.array(at).T, np.array([y for _, y in members])))
    k = len(LABELS)
    emit, move = np.zeros((len(index), k)), np.zeros((k, k))
    seen_e, seen_m = np.full_like(emit, 1e-6), np.full_like(move, 1e-6)
    total = len(table)
    for _ in range(steps):
        ge, gm = -l2 * emit, -l2 * move
        for length, (m, t, f), y in batches:
            scores = np.zeros((len(y), length, k))
            np.add.at(scores, (m, t), emit[f])
            pair = move + ALLOWED
            forward, backward = [scores[:, 0] + START], [np.zeros((len(y), k))]
            for i in range(1, length):
                forward.append(_log_sum(forward[-1][:, :, None] + pair, 1) + scores[:, i])
            for i in range(length - 1, 0, -1):
                backward.append(_log_sum(pair + (scores[:, i] + backward[-1])[:, None, :], 2))
            backward = backward[::-1]
            z = _log_sum(forward[-1], 1)
            diff = -np.exp(np.stack(forward, 1) + np.stack(backward, 1) - z[:, None, None])
            diff[np.arange(len(y))[:, None], np.arange(length)[None, :], y] += 1
            np.add.at(ge, f, diff[m, t] / total)
            for i in range(1, length):
                joint = forward[i - 1][:, :, None] + pair + (scores[:, i] + backward[i])[:, None, :] - z[:, None, None]
                gm -= np.exp(joint).sum(axis=0) / total
                np.add.at(gm, (y[:, i - 1], y[:, i]), 1 / total)
        seen_e += ge**2
        seen_m += gm**2
        emit += rate * ge / np.sqrt(seen_e)
        move += rate * gm / np.sqrt(seen_m)
    return Crf(index, emit, move)


def _spans(chain: list[tuple[str, int, int]], labels: list[int]) -> list[tuple[int, int, int]]:
    out: list[tuple[int, int, int]] = []
    for (_, start, end), label in zip(chain, labels):
        if label % 2:  # B-kind
            out.append((start, label // 2, end))
        elif label:  # I-kind goes on
            s, kind, _ = out[-1]
            out[-1] = (s, kind, end)
    return out


def find_spans(batch: list[str], model: Crf) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text."""
    base = [base_spans(t) for t in batch]
    places = [(i, c) for i, t in enumerate(batch) for c in chains(t)]
    decoded = model.decode([[core for core, _, _ in c] for _, c in places])
    added: list[list] = [[] for _ in batch]
    for (i, chain), labels in zip(places, decoded):
        for start, kind, end in _spans(chain, labels):
            if all(end <= s or start >= e for s, _, e in base[i]):
                added[i].append((start, kind, end))
    return list(zip(base, added))


OWN = StructType(
    [
        *[StructField(f"n_{k}", LongType()) for k in KINDS],
        StructField("base_sha256", StringType()),
        StructField("spans", StringType()),
        StructField("redacted", StringType()),
    ]
)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span as [KIND]; of overlapping spans the first, and of those the longest, covers."""
    out, at = [], 0
    for start, kind, end in sorted(spans, key=lambda s: (s[0], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def find_pii(docs: DataFrame, text: str = "text", table=None, redacted: bool = True) -> DataFrame:
    """(``_doc``, counts of base spans by kind, digest of base spans, all spans, redacted text).

    ``_doc`` holds the columns of ``docs``. ``table`` replaces the labelled table. The
    model is a few thousand numbers and goes to each task with the function.
    """
    model = train(labelled_table() if table is None else table)
    columns, body = doc_with_text(docs, text)
    wide = docs.select(*columns)
    schema = StructType([wide.schema["_doc"], *OWN.fields])

    def run(batch, _) -> dict:
        source = texts(batch, body)
        found = find_spans(source, model)
        out = {"_doc": batch.column(0), "base_sha256": [], "spans": [], "redacted": []} | {f"n_{k}": [] for k in KINDS}
        for t, (base, added) in zip(source, found):
            for i, k in enumerate(KINDS):
                out[f"n_{k}"].append(sum(x[1] == i for x in base))
            out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
            out["spans"].append(written(base + added))
            out["redacted"].append((redact(t, base + added) if base or added else t) if redacted else None)
        return out

    return map_columns(wide, run, schema)


def redact_rows(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; ``length`` counts its characters anew."""
    found = find_pii(docs, text)
    old, new = F.col(f"_doc.`{text}`"), F.col("redacted")

    def column(name: str):
        # a column of the caller may have any name, so its values stay in the struct
        value = F.col(f"_doc.`{name}`")
        if name == text:
            value = F.when(old.isNotNull(), new)
        elif name == length:
            value = F.when(old.isNotNull(), F.char_length(new)).otherwise(value).cast(docs.schema[name].dataType)
        return value.alias(name)

    return found.select(*[column(c) for c in docs.columns])
