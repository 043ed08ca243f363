"""Plain versions of the operators, row by row, to hold results against."""

import collections
import hashlib
import math
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def jaccard_groups(rows, size, percent):
    """{place of a row: (set size, smallest id of its group, number of rows linked with it)}."""
    sets = [shingles(text, size) for _, text in rows]
    parent, links, holders = list(range(len(rows))), collections.Counter(), collections.defaultdict(list)

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, own in enumerate(sets):
        shared = collections.Counter(j for gram in own for j in holders[gram])
        for j, n in shared.items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
                parent[top(i)] = top(j)
        for gram in own:
            holders[gram].append(i)
    ids = collections.defaultdict(list)
    for i, (id_, _) in enumerate(rows):
        if id_ is not None:
            ids[top(i)].append(id_)
    return {i: (len(sets[i]), min(ids[top(i)], default=None), links[i]) for i in range(len(rows))}


def dropped_lines(rows, least_words):
    """{(id, line number): place of the earliest line that matches}, rows in order of id."""
    seen, out = [], {}
    for id_, text in rows:
        for number, line in enumerate((text or "").split("\n")):
            words = WORD.findall(line)
            if not words:
                continue
            own = frozenset(words)
            for place, other, theirs in seen:
                near = abs(len(words) - len(other)) <= 1 and len(own ^ theirs) <= 2  # else there are two edits
                near = near and max(len(words), len(other)) >= least_words and edits(words, other) <= 1
                if other == words or near:
                    out[(id_, number)] = place
                    break
            seen.append(((id_, number), words, own))
    return out


def edits(a, b):
    """Edit distance of two lists of words."""
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def smallest_capacity(sizes, shards):
    """Smallest capacity for which consecutive sizes fit in so many shards."""

    def fits(capacity):
        used, held = 1, 0
        for size in sizes:
            if size > capacity:
                return False
            if held + size > capacity:
                used, held = used + 1, 0
            held += size
        return used <= shards

    low, high = 0, sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


def poisson(mean, seed, id_, step, depth):
    """The draw of a row: sums of draws of equal parts, each by inverting the law at a hash."""
    parts = max(1, math.ceil(mean / step))
    total = 0
    for part in range(1, parts + 1):
        digest = hashlib.md5(f"{seed}|{'null' if id_ is None else id_}|{part}".encode()).hexdigest()
        u = int(digest[:13], 16) / float(1 << 52)
        p = cumulative = math.exp(-mean / parts)
        for k in range(depth + 1):
            total += cumulative <= u
            p = p * (mean / parts) / (k + 1)
            cumulative += p
    return total


_TOKEN = re.compile(r"[^\W_]", re.UNICODE)


def templates(text, window, least_fixed, units):
    """[(place, template, slots)] of a text, token by token."""
    tokens = []
    for line in (text or "").split("\n"):
        opens = True
        for word in re.split(r"[\x20\x09-\x0D]+", line):
            core = re.sub(r"^[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+|[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+$", "", word)
            if not core:
                continue
            low = core.translate(LOWER)
            fixed = re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", "", low)
            alone = "N" if core[0] in "0123456789" else ""
            capitals = [i for i, c in enumerate(core) if re.match(r"[A-ZÀ-ÖØ-ÞА-ЯΑ-Ω]", c)]
            name = not alone and capitals == [0] and len(core) > 1 and not opens
            unit = bool(tokens) and tokens[-1][2] == "N" and low in units
            tokens.append((fixed, "U" if unit else "P" if name else alone, alone))
            opens = word[-1] in ".?!:"
    out = []
    for at in range(len(tokens) - window + 1):
        part = [(tokens[at][0], tokens[at][2]), *[(v, k) for v, k, _ in tokens[at + 1 : at + window]]]
        if sum(not kind for _, kind in part) >= least_fixed:
            template = tuple((kind or value) if not kind else (kind,) for value, kind in part)
            out.append((at, template, tuple(v for v, kind in part if kind)))
    return out


def leaks(docs, items, window, least_fixed, run, units):
    """{(id, item)} of documents that hold an item's template with one-to-one values."""
    keys, counts = collections.defaultdict(list), {}
    for item, text in items:
        found = templates(text, window, least_fixed, units)
        counts[item] = len(found)
        for at, template, slots in found:
            keys[template].append((item, at, slots))
    out = set()
    for id_, text in docs:
        runs = collections.defaultdict(list)
        for at, template, slots in templates(text, window, least_fixed, units):
            for item, item_at, item_slots in keys.get(template, []):
                if one_to_one(set(zip(item_slots, slots, strict=True))):
                    runs[(item, at - item_at)].append((item_at, item_slots, slots))
        for (item, _), found in runs.items():
            pairs = {pair for _, a, b in found for pair in zip(a, b, strict=True)}
            if one_to_one(pairs) and len({at for at, _, _ in found}) >= min(counts[item], run - window + 1):
                out.add((id_, item))
    return out


def one_to_one(pairs):
    return len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
