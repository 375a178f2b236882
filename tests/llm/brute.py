"""Plain, slow versions of the corpus contracts, for small tables."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def base_counts(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    inside = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    lines, seen = 0, set()
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(inside), n < 20 or 100 * len(inside) > 30 * n


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


PERSONAL = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m[0])) <= 19 and luhn(re.sub("[^0-9]", "", m[0]))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15),
}
SECRET = {
    "assign": (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
}


def spans(text: str | None, kinds: dict, by_start: bool) -> list[tuple[str, int, int]]:
    found = [(k, m.start(), m.end()) for k, (pattern, ok) in kinds.items() for m in re.finditer(pattern, text or "", re.ASCII) if ok(m)]
    order = list(kinds)
    return sorted(found, key=(lambda x: (x[1], order.index(x[0]))) if by_start else (lambda x: (order.index(x[0]), x[1])))


def digest(found: list) -> str:
    return sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found))


def payload(html: str | None) -> tuple[int, str]:
    data = (html or "").encode("utf-8")
    return len(data), base64.b32encode(hashlib.sha1(data).digest()).decode()


def targets(sizes: dict) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, out, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not above:
            return out | share
        out |= {s: 2.0 * sizes[s] for s in above}
        left -= sum(2.0 * sizes[s] for s in above)
        open_ -= above
    return out


def shingle_set(text: str | None) -> frozenset:
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def near_duplicates(texts: dict[int, str | None]) -> dict[int, tuple]:
    sets = {k: shingle_set(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k), find(k) == k) for k in ids}


def held_out(key) -> bool:
    return zlib.crc32(str(key).encode()) % 4 == 2


def rank_profile(counts: Counter, size: int) -> dict[str, int]:
    """N-grams by falling count, ties in the order of their code points with a missing character first."""
    return {g: i for i, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size])}


def ngrams(text: str) -> Counter:
    """Of 1 to 3 characters over lower-case words of letters, one space between and around them."""
    low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
    line = f" {' '.join(low.split(' '))} ".replace("\t", " ")
    while "  " in line:
        line = line.replace("  ", " ")
    found = Counter(c for c in line if c != " ")
    found.update(line[i : i + 2] for i in range(len(line) - 1))
    found.update(line[i : i + 3] for i in range(len(line) - 2) if line[i + 1] != " ")
    return found if any(c != " " for c in line) else Counter()


def out_of_place(text: str | None, profiles: dict[str, dict[str, int]], size: int) -> tuple[str, float]:
    own = rank_profile(ngrams(text or ""), size)
    if not own or not profiles:
        return "und", 0.0
    likeness = {}
    for lang in sorted(profiles):
        away = sum(min(abs(profiles[lang][g] - i), size) if g in profiles[lang] else size for g, i in own.items())
        likeness[lang] = 1 - away / (size * len(own))
    best = max(sorted(likeness), key=likeness.get)
    total = sum(likeness.values())
    return best, likeness[best] / total if total > 0 else 0.0


def terms(text: str) -> list[str]:
    import regex

    return regex.findall(r"[\p{L}\p{N}]{3,}+", text.lower())


def disclosing(texts: list[str | None], window: int, support: int, generalise: float) -> dict[tuple[str, str], float]:
    """PMI over information content of each term beside each entity, counted document by document."""
    import math
    import regex

    word = r"[\p{L}\p{N}]+"
    n_term, n_entity, n_both = Counter(), Counter(), Counter()
    contexts: dict[tuple[str, str], dict[str, tuple]] = {}
    for text in texts:
        text = text or ""
        n_term.update(set(terms(text)))
        beside: dict[str, set] = {}
        for kind, a, b in spans(text, PERSONAL, False):
            hit = text[a:b]
            entity = f"{kind}:" + (re.sub("[^0-9]", "", hit) if kind in ("card", "phone") else hit.lower())
            before, after = text[max(0, a - window) : a], text[b : b + window]
            near = (regex.sub("^" + word, "", before) if a > window else before) + " " + (regex.sub(word + "$", "", after) if b + window < len(text) else after)
            beside.setdefault(entity, set())
            for t in set(terms(near)):
                beside[entity].add(t)
                contexts.setdefault((entity, t), {}).setdefault(text, set()).add((before, after))
        for entity, near in beside.items():
            n_entity[entity] += 1
            n_both.update((entity, t) for t in near)
    total, out = len(texts), {}
    for (entity, t), by_text in contexts.items():
        # a text counts once, and texts of the same contexts count as one; the operator picks one context of each text
        if all(len(c) == 1 for c in by_text.values()):
            if len({next(iter(c)) for c in by_text.values()}) < support:
                continue
        elif len(by_text) < support:
            continue
        ic = math.log(total / n_entity[entity])
        pmi = math.log(n_both[entity, t] * total / (n_term[t] * n_entity[entity]))
        value = pmi / ic if ic > 0 else 0.0
        if value >= generalise:
            out[entity, t] = value
    return out


def quality_shape(text: str) -> tuple[set, list[float]]:
    """The words, prefixes and shape of a text, character by character."""
    import math
    import unicodedata

    low, words, word = text.lower(), [], ""
    for c in low + " ":
        if unicodedata.category(c)[0] == "L":
            word += c
        else:
            words += [word] if word else []
            word = ""
    some, n = set(words), max(1, len(text))
    kind = lambda c: "upper" if c.isupper() else "letter" if c.isalpha() else "digit" if c.isdigit() else "space" if c.isspace() else "other"
    kinds = Counter(map(kind, text))
    lines = [x for x in text.split("\n") if x.strip()]
    shape = [text.count(c) / n for c in "#*$%&|<>!"] + [kinds["upper"] / n, kinds["digit"] / n, kinds["other"] / n]
    shape += [1 - len(some) / max(1, len(words)), 1 - len(set(lines)) / max(1, len(lines)), math.log(1 + len(words)), min(50.0, n / max(1, len(words)))]
    return some | {w[:5] + "*" for w in some if len(w) > 5}, shape


def logistic(z: float) -> float:
    import math

    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def site_chances(p: list[float], hosts: list, paths: list, most_prior: float = 1e6, edge: float = 1e-6) -> list[float]:
    """Chances that take host and path into account, each document left out of its own site's sums."""
    import math

    def mean(x):
        return sum(x) / len(x)

    sites = [(h, q) for h, q in zip(hosts, paths)]
    of = lambda keys: {k: [i for i, x in enumerate(keys) if x == k] for k in set(keys)}
    by_host, by_path, total = of(hosts), of(sites), mean(p)
    spread = sum((p[i] - mean([p[j] for j in m])) ** 2 for m in by_path.values() for i in m)
    within = max(edge, spread / max(1, len(p) - len(by_path)))

    def weight(groups, above):
        far = sum(len(m) * (mean([p[i] for i in m]) - above(m)) ** 2 for m in groups.values())
        scale = len(p) - sum(len(m) ** 2 for m in groups.values()) / len(p)
        between = (far - (len(groups) - 1) * within) / scale if len(groups) > 1 and scale > 0 else 0
        return min(most_prior, within / between) if between > 0 else most_prior

    k_host = weight(by_host, lambda m: total)
    k_path = weight(by_path, lambda m: mean([p[i] for i in by_host[hosts[m[0]]]]))
    logit = lambda x: math.log(min(1 - edge, max(edge, x)) / (1 - min(1 - edge, max(edge, x))))
    out = []
    for i, x in enumerate(p):
        h, q = by_host[hosts[i]], by_path[sites[i]]
        of_host = (k_host * total + sum(p[j] for j in h) - x) / (k_host + len(h) - 1)
        of_path = (k_path * of_host + sum(p[j] for j in q) - x) / (k_path + len(q) - 1)
        out.append(1 / (1 + math.exp(-(logit(x) + logit(of_path) - logit(total)))))
    return out
