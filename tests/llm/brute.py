"""Plain versions of the operators, for small inputs."""

import hashlib
import math
from collections import Counter, defaultdict


def words(text):
    return (text or "").encode().split()


def place(doc_id, k):
    return (doc_id is None, doc_id or 0, k)


def jaccard(rows, size=5, threshold=0.8):
    sets = [frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if (w := words(t)) else frozenset() for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if shared >= threshold * (len(sets[a]) + len(sets[b]) - shared) - 1e-9:
                    links[a] += 1
                    links[b] += 1
                    root[find(a)] = find(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None and sets[k]:
            least[find(k)] = min(d, least.get(find(k), d))
    return sorted(((d, least[find(k)] if d is not None and sets[k] else d, links[k]) for k, (d, _) in enumerate(rows)), key=repr)


def lines_gone(rows, least_words=5):
    lines = sorted((place(d, k), d, k, tuple(words(line))) for d, t in rows for k, line in enumerate((t or "").split("\n")))
    whole, cut, swapped, gone = {}, {}, {}, set()
    for at, d, k, w in lines:
        if len(w) < least_words:  # no neighbours; blank lines stay
            if w and whole.setdefault(w, at) < at:
                gone.add((d, k))
            continue
        shorter = [w[:i] + w[i + 1 :] for i in range(len(w))]
        met = [whole.get(w), cut.get(w), *(whole.get(s) for s in shorter), *(swapped.get((i, s)) for i, s in enumerate(shorter))]
        if any(m is not None and m < at for m in met):
            gone.add((d, k))
        whole.setdefault(w, at)
        for i, s in enumerate(shorter):
            cut.setdefault(s, at)
            swapped.setdefault((i, s), at)
    return gone


def repeats(rows, window=20):
    """(doc_id, n_words, n_removed, kept) of each row."""
    first, out = {}, []
    for d, t in sorted(rows, key=lambda r: place(r[0], 0)):
        w = words(t)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), place(d, i))
    for d, t in rows:
        w = words(t)
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] != place(d, i) for j in range(i, i + window)}
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def language_model(rows, training, rounds=60):
    """[(doc_id, n_tokens, n_known, base_score, score)] of each row, and the number of training tokens: counts in dictionaries, weights by expectation-maximisation one cell after another."""
    texts = [(d, [*(t or "").encode().lower().split(), b""]) for d, t in rows]
    one, two = defaultdict(int), defaultdict(int)
    for d, w in texts:
        for a, b in zip([b"", *w], w, strict=False) if training(d) else ():
            one[b] += 1
            two[a, b] += 1
    total, uniform = sum(one.values()), 1 / (len(one) + 1)
    bucket = lambda c: c.bit_length()  # noqa: E731  0, then one for each power of two
    on_grid = lambda a, b: round(8 * math.log2(a / b)) if a > 0 and b > 0 else None
    value = lambda g: 0.0 if g is None else 2 ** (g / 8)
    cells = defaultdict(int)
    for (a, b), n in two.items():
        cells[bucket(one[a] - 1), on_grid(n - 1, one[a] - 1), on_grid(one[b] - 1, total - 1)] += n

    def climb(own, w):
        for _ in range(rounds):
            shares = [0.01] * 3
            for (_, p3, p2), n in own:
                parts = [w[0] * uniform, w[1] * value(p2), w[2] * value(p3)]
                for k in range(3):
                    shares[k] += n * parts[k] / sum(parts)
            w = [x / sum(shares) for x in shares]
        return w

    whole = climb(cells.items(), [1 / 3] * 3) if cells else [1.0, 0.0, 0.0]
    weights = {k: climb([c for c in cells.items() if c[0][0] == k], whole) for k in {c[0] for c in cells}}
    none = weights.get(0, whole)
    weights[0] = [none[0] / (none[0] + none[1]), none[1] / (none[0] + none[1]), 0.0]
    out = []
    for d, words in texts:
        score = base = known = 0
        for a, b in zip([b"", *words], words, strict=False):
            w, c = weights.get(bucket(one.get(a, 0)), whole), one.get(b, 0)
            score += math.log10(w[0] * uniform + (w[1] * c / total if total else 0) + (w[2] * two.get((a, b), 0) / one[a] if one.get(a) else 0))
            base += math.log10((c + 0.5) / (total + 0.5 * (len(one) + 1)))
            known += c > 0
        out.append((d, len(words), known, base, score))
    return total, out


def mix_targets(sizes, weights=(5, 2, 1), most=3):
    """{source: target} from {source: size}: what is above most times a size is shared anew until none is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in full)
        share = sum(w for s, w in weight.items() if s not in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / share for s in order}
        above = {s for s in order if s not in full and target[s] > most * sizes[s]}
        if not above:
            return target
        full |= above


def mixed(rows, seed="mix-1"):
    """How often each doc_id is taken into the mix, from rows (doc_id, text, source)."""
    streams, taken = defaultdict(list), Counter()
    for d, t, source in rows:
        turn = hashlib.md5(f"{seed}{'' if d is None else d}:{t or ''}".encode()).hexdigest()[:16]
        streams[source].append((turn, len(words(t)), d))
    targets = mix_targets({s: sum(x[1] for x in own) for s, own in streams.items()})
    for source, own in streams.items():
        size, demand = sum(x[1] for x in own), math.floor(targets[source] + 0.5)
        rest = demand - demand // size * size if size else 0
        groups, start = defaultdict(list), 0
        for x in own:
            groups[x[0]].append(x)
        for turn in sorted(groups):
            n = sum(x[1] for x in groups[turn])
            more = rest > start and 2 * (rest - start) >= n
            for _, k, d in groups[turn]:
                if k:
                    taken[d] += demand // size + more
            start += n
    return +taken


def library_tokens(vocabulary, texts):
    from tokenizers import Tokenizer

    return [len(x.ids) for x in Tokenizer.from_file(vocabulary).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def kneser_ney(counts, asked, order=5, discount=0.75):
    """log p(toxic) - log p(ordinary) of the asked words, from {word: (toxic, ordinary)}: sums of characters after order - 1 others, lower orders by continuation counts of both classes."""
    padded = lambda w: ["^"] * (order - 1) + list(w) + ["$"]
    grams = lambda w: [tuple(padded(w)[k - order + 1 : k + 1]) for k in range(order - 1, len(padded(w)))]
    seen = [defaultdict(int), defaultdict(int)]
    for w, both in counts.items():
        for g in grams(w):
            for k in (0, 1):
                seen[k][g] += both[k]
    every = {g for g in [*seen[0], *seen[1]]}

    def shared(g):
        p = 1 / 4096
        for n in range(1, order):
            longer = {x[-n - 1 :] for x in every}
            tail, head = g[-n:], g[-n:-1] if n > 1 else ()
            same_head = [x for x in longer if x[1:-1] == head]
            count, total, kinds = sum(x[1:] == tail for x in same_head), len(same_head), len({x[1:] for x in same_head})
            p = max(count - discount, 0) / total + discount * kinds / total * p
        return p

    lower = {g: shared(g) for g in every}
    totals, kinds = [defaultdict(int), defaultdict(int)], [defaultdict(int), defaultdict(int)]
    for k in (0, 1):
        for g, n in seen[k].items():
            totals[k][g[:-1]] += n
            kinds[k][g[:-1]] += n > 0
    contexts = {g[:-1] for g in every}
    left = lambda k, c: discount * kinds[k][c] / totals[k][c] if totals[k][c] else 1.0

    def one(g):
        c = g[:-1]
        if g in every:
            p = [(max(seen[k][g] - discount, 0) / totals[k][c] if totals[k][c] else 0) + left(k, c) * lower[g] for k in (0, 1)]
            return math.log(p[0]) - math.log(p[1])
        return math.log(left(0, c)) - math.log(left(1, c)) if c in contexts else 0.0

    return [sum(map(one, grams(w))) for w in asked]
