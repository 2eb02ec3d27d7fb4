"""A small semi-Markov conditional random field over segments of a text region.

A region is a list of units (runs of letters and digits, white space, single other characters). A segmentation covers it with
segments: outside segments of one unit, which score nothing, and entity segments of at most MOST units, which
score the weights of their whole-span features for their type. Training is by exact marginals (forward and backward
sums over all segmentations), decoding by the best segmentation. Entities are bounded, so both are linear in length.
"""

from __future__ import annotations

import functools
import math
import random
import re
import string

import numpy as np

TYPES = ("email", "ip", "phone", "secret")
MOST = 16
UNIT = re.compile(r"[^\W_]+|\s+|.", re.S)
_CUE = re.compile(r"(?i)(?:password|passwd|pwd|token|secret|key|credential|auth)\w*[\"']?\s*[:=]?\s*[\"']?$")
_CALL = re.compile(r"(?i)(?:phone|tel|call|fax|mobile|cell)\w*\W{0,3}$")
_HEX = re.compile(r"[0-9a-fA-F]+")
_RUN = re.compile(r"[A-Za-z0-9_+/=-]+")
_SHAPE_PHONE = re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}")
_IP6 = re.compile(r"[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){3,7}")
_AT = re.compile(r"(?i)[a-z0-9._-]+ ?[\[(] ?at ?[\])] ?[a-z0-9-]+(?: ?(?:\.|[\[(] ?dot ?[\])]| dot ) ?[a-z0-9-]+)+")
_CLOUD = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk[-_][0-9A-Za-z_-]{20,}|xox[abp]-[0-9A-Za-z-]{10,}")
FEATURES = (
    "any", "digits<7", "digits 7-9", "digits 10-11", "digits>11", "no capital", "capital and small", "digit and letter", "changes>4", "length<8", "length 8-15", "length 16-23", "length>23", "one run", "hex", "phone shape",
    "ip6 shape", "at shape", "cloud key", "cue before", "call before", "space inside", "dot inside", "colon inside", "slash inside", "run goes on", "quoted", "word edge",
)
N = len(FEATURES)


def features(text: str, a: int, b: int) -> list[int]:
    """Numbers of the features that hold for text[a:b]."""
    s = text[a:b]
    digits = sum(map(str.isdigit, s))
    before, after, head = text[a - 1 : a], text[b : b + 1], text[max(0, a - 24) : a]
    one_run = _RUN.fullmatch(s) is not None
    letters = any(map(str.isalpha, s))
    capital, small = any(map(str.isupper, s)), any(map(str.islower, s))
    changes = sum(x.isdigit() != y.isdigit() for x, y in zip(s, s[1:], strict=False))
    n = len(s)
    holds = (
        True, digits < 7, 7 <= digits <= 9, 10 <= digits <= 11, digits > 11, not capital, capital and small, letters and digits > 0, changes > 4, n < 8, 8 <= n <= 15, 16 <= n <= 23, n > 23,
        one_run, n >= 12 and _HEX.fullmatch(s) is not None, _SHAPE_PHONE.fullmatch(s) is not None, _IP6.fullmatch(s) is not None and (s.count(":") == 7 or "::" in s) and digits > 0, _AT.fullmatch(s) is not None, _CLOUD.fullmatch(s) is not None,
        _CUE.search(head) is not None, _CALL.search(head) is not None, " " in s, "." in s, ":" in s, "/" in s,
        bool(before and _RUN.fullmatch(before) and before not in "=") or bool(after and _RUN.fullmatch(after)), before in ('"', "'") and after == before, s[0].isalnum() and s[-1].isalnum(),
    )
    return [i for i, h in enumerate(holds) if h]


def units(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in UNIT.finditer(text, start, end)]


def candidates(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int, list[int]]]:
    """(first unit, unit after the last, features) of each segment that may be an entity: it has a digit or an (at), and no line break or outer space."""
    out = []
    kinds = [text[a:b] for a, b in spans]
    for i, first in enumerate(kinds):
        if not (first[0].isalnum() or first in "(+:"):
            continue
        good = False
        for j in range(i, min(len(kinds), i + MOST)):
            u = kinds[j]
            if "\n" in u or len(u) > 1 and u.isspace():
                break
            good = good or any(map(str.isdigit, u)) or u.lower() == "at"
            if good and (u[0].isalnum() or u in "=:"):
                a, b = spans[i][0], spans[j][1]
                if b - a >= 7:
                    out.append((i, j + 1, features(text, a, b)))
    return out


def best(n: int, cands: list[tuple[int, int, list[int]]], weights: np.ndarray) -> list[tuple[int, int, int]]:
    """The best segmentation's entities (first unit, unit after the last, type) over n units."""
    ending: dict[int, list[tuple[float, int, int]]] = {}
    for i, j, f in cands:
        scores = weights[:, f].sum(axis=1)
        k = int(scores.argmax())
        if scores[k] > 0:  # outside segments score nothing, so others never help
            ending.setdefault(j, []).append((float(scores[k]), i, k))
    if not ending:
        return []
    value, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        value[j] = value[j - 1]
        for s, i, k in ending.get(j, ()):
            if value[i] + s > value[j]:
                value[j], back[j] = value[i] + s, (i, k)
    out, j = [], n
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            i, k = back[j]
            out.append((i, j, k))
            j = i
    return out[::-1]


def log_sum(n: int, cands: list[tuple[int, int, list[int]]], weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The logarithm of the sum over all segmentations, each candidate's marginal by type, and its features as a row of 0 and 1."""
    held = np.zeros((len(cands), N))
    for c, (_, _, f) in enumerate(cands):
        held[c, f] = 1
    scores = held @ weights.T
    total = np.logaddexp.reduce(scores, axis=1).tolist() if len(cands) else []
    ends, starts = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
    for c, (i, j, _) in enumerate(cands):
        ends[j].append(c)
        starts[i].append(c)
    left, right = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        left[j] = _log_add(left[j - 1], [left[cands[c][0]] + total[c] for c in ends[j]])
    for i in range(n - 1, -1, -1):
        right[i] = _log_add(right[i + 1], [right[cands[c][1]] + total[c] for c in starts[i]])
    outer = np.array([left[i] + right[j] for i, j, _ in cands]) - left[n]
    return left[n], np.exp(scores + outer[:, None]) if len(cands) else scores, held


def _log_add(one: float, more: list[float]) -> float:
    top = max(one, *more) if more else one
    return top + math.log(sum(math.exp(x - top) for x in (one, *more))) if more else one


def _example(rng: random.Random) -> tuple[str, list[tuple[str, str]]]:
    """A made line of text with the entities in it."""
    letters, both = string.ascii_lowercase, string.ascii_letters + string.digits
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    word = lambda: pick(letters, rng.randint(2, 9))
    num = lambda n: pick(string.digits, n)
    cue = rng.choice(["password", "token", "api_key", "secret", "access key", "auth_token", "pwd"])
    made = rng.choice([
        ("secret", lambda: ("", "AKIA" + pick(string.ascii_uppercase + string.digits, 16), "")),
        ("secret", lambda: (cue + rng.choice(["=", ": ", " = "]), pick("0123456789abcdef", rng.choice([12, 16, 18, 32])), "")),
        ("secret", lambda: (cue + rng.choice(["=", " = ", ": "]) + '"', pick("0123456789abcdef", rng.choice([32, 40, 64])), '"')),
        ("secret", lambda: (cue + rng.choice(["=", ": "]), pick(both, rng.randint(14, 40)) + "7a", "")),
        ("phone", lambda: (rng.choice(["", "tel ", "call "]), rng.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}"]), "")),
        ("email", lambda: ("", f"{word()}{num(2)} {rng.choice(['(at)', '[at]'])} {word()}{rng.choice([' (dot) ', ' [dot] ', ' dot ', '.'])}com", "")),
        ("ip", lambda: ("", ":".join(pick("0123456789abcdef", 4) for _ in range(8)), "")),
        *[("", f) for f in (
            lambda: ("", rng.choice(["4.0", "2.0.1", "version 3", "1,299.00", "10:30", "2021-05-06", "page 12", "12/05/2021", "3rd", "v2.10.3"]), ""), lambda: ("", num(rng.randint(1, 10)), ""), lambda: ("", num(16), ""), lambda: ("", num(13), ""),
            lambda: ("", f"{num(4)}-{num(4)}", ""), lambda: ("", f"{word()}{num(2)} {num(4)} {word()}", ""), lambda: ("", f"{word()}.example/{word()}/{num(5)}?page={num(1)}", ""), lambda: ("", f"{num(2)}:{num(2)}:{num(2)}", ""),
            lambda: ("", f"{num(3)} {num(3)} {num(3)}", ""), lambda: ("", f"isbn 978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", ""), lambda: (cue + " ", f"{word()} {num(3)} {word()}", ""), lambda: ("", f"{word()}{num(3)}{word()}", ""),
            lambda: ("", f"{word().upper()}-{num(4)}", ""), lambda: ("", f"{num(1)}.{num(3)}.{num(3)}", ""), lambda: ("", f"{word()}_{num(2)}_{word()}_{num(4)}_{word()}", ""),
        )],
    ])
    before, body, after = made[1]()
    text = f"{word()} {word()} {before}{body}{after}{rng.choice(['', '.', ','])} {word()} {word()}"
    return text, [(made[0], body)] if made[0] else []


def examples(n: int, seed: int) -> list[tuple[str, list[tuple[str, str]]]]:
    rng = random.Random(seed)
    return [_example(rng) for _ in range(n)]


@functools.lru_cache(maxsize=1)
def trained(n: int = 240, rounds: int = 90, seed: int = 11) -> np.ndarray:
    """Weights, types x features, of the model trained on n made lines: deterministic, about two seconds of one core."""
    data = []
    for text, gold in examples(n, seed):
        spans = units(text, 0, len(text))
        cands = candidates(text, spans)
        at = {(spans[i][0], spans[j - 1][1]): c for c, (i, j, _) in enumerate(cands)}
        data.append((len(spans), cands, [(at[text.index(s), text.index(s) + len(s)], TYPES.index(k)) for k, s in gold if (text.index(s), text.index(s) + len(s)) in at]))
    w, seen = np.zeros((len(TYPES), N)), np.full((len(TYPES), N), 1e-2)
    for _ in range(rounds):
        step = -0.02 * w
        for count, cands, gold in data:
            _, marginal, held = log_sum(count, cands, w)
            step -= marginal.T @ held
            for c, k in gold:
                step[k, cands[c][2]] += 1
        seen += step**2
        w += 0.5 * step / np.sqrt(seen)
    return w
