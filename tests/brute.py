"""Plain versions of operators, to compare small results with."""

import hashlib
from collections import Counter, defaultdict


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def uniform(*parts):
    return int(md5("|".join(str(p) for p in parts))[:8], 16) / 2**32


def regions(values, target, edges):
    """Round-wise merging of mutually cheapest neighbours."""
    label = list(range(len(values)))
    size = {i: 1.0 for i in label}
    mean = dict(enumerate(values))
    pairs = {tuple(sorted(e)) for e in edges}
    while len(size) > target:
        best, cost_of = {}, {}
        for a, b in pairs:
            gap = mean[a] - mean[b]
            cost = size[a] * size[b] / (size[a] + size[b]) * gap * gap
            key = (cost, md5(f"{a}|{b}"), a, b)
            cost_of[a, b] = key
            for end in (a, b):
                best[end] = min(best.get(end, key), key)
        mutual = sorted(k for (a, b), k in cost_of.items() if best[a] == k == best[b])
        for _, _, a, b in mutual[: len(size) - target]:
            n = size[a] + size[b]
            mean[a] = (size[a] * mean[a] + size[b] * mean[b]) / n
            size[a] = n
            del size[b], mean[b]
            label = [a if x == b else x for x in label]
            pairs = {tuple(sorted((a if x == b else x, a if y == b else y))) for x, y in pairs}
            pairs = {p for p in pairs if p[0] != p[1]}
    groups = defaultdict(list)
    for place, region in enumerate(label):
        groups[region].append(place)
    members = sorted(groups.values())
    return [md5(",".join(str(p - m[0]) for p in m)) for m in members]


def lattice(n_pixels):
    for i in range(n_pixels * 3):
        if i % 3 < 2:
            yield i, i + 1
        if i + 3 < n_pixels * 3:
            yield i, i + 3


def literal_votes(cand_rows, cluster_rows, key_rows):
    """The two joins written out: on the cluster alone, then on the token.

    cand_rows: (cluster, token, cand); cluster_rows: (cluster, token);
    key_rows: (token, key).
    """
    by_cluster, by_token = Counter(c for c, _ in cluster_rows), defaultdict(list)
    for token, key in key_rows:
        by_token[token].append(key)
    votes = Counter()
    for cluster, token, cand in cand_rows:
        for _ in range(by_cluster[cluster]):
            for key in by_token[token]:
                votes[cand, key] += 1
    return votes


def best_of(votes):
    """cand -> (best key, votes, total); the lowest key wins a tie."""
    per = defaultdict(dict)
    for (cand, key), n in votes.items():
        per[cand][key] = n
    out = {}
    for cand, keys in per.items():
        n, key = min((-n, k) for k, n in keys.items())
        out[cand] = (key, -n, sum(keys.values()))
    return out
