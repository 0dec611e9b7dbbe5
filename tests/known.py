"""Small graphs with known answers."""

from fractions import Fraction as Fr

# Zachary's karate club, one pair per friendship.
KARATE = [
    (1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4), (1, 5), (1, 6), (1, 7), (5, 7), (6, 7), (1, 8), (2, 8),
    (3, 8), (4, 8), (1, 9), (3, 9), (3, 10), (1, 11), (5, 11), (6, 11), (1, 12), (1, 13), (4, 13), (1, 14),
    (2, 14), (3, 14), (4, 14), (6, 17), (7, 17), (1, 18), (2, 18), (1, 20), (2, 20), (1, 22), (2, 22), (24, 26),
    (25, 26), (3, 28), (24, 28), (25, 28), (3, 29), (24, 30), (27, 30), (2, 31), (9, 31), (1, 32), (25, 32),
    (26, 32), (29, 32), (3, 33), (9, 33), (15, 33), (16, 33), (19, 33), (21, 33), (23, 33), (24, 33), (30, 33),
    (31, 33), (32, 33), (9, 34), (10, 34), (14, 34), (15, 34), (16, 34), (19, 34), (20, 34), (21, 34), (23, 34),
    (24, 34), (27, 34), (28, 34), (29, 34), (30, 34), (31, 34), (32, 34), (33, 34),
]

# Normalized scores of the karate club.
KARATE_NODES = {
    1: 0.43763528138528146, 2: 0.05393668831168831, 3: 0.14365680615680615, 4: 0.011909271284271283,
    5: 0.0006313131313131313, 6: 0.02998737373737374, 7: 0.029987373737373736, 8: 0.0, 9: 0.05592682780182781,
    10: 0.0008477633477633478, 11: 0.0006313131313131313, 12: 0.0, 13: 0.0, 14: 0.04586339586339585, 15: 0.0,
    16: 0.0, 17: 0.0, 18: 0.0, 19: 0.0, 20: 0.032475048100048115, 21: 0.0, 22: 0.0, 23: 0.0,
    24: 0.017613636363636366, 25: 0.0022095959595959595, 26: 0.0038404882154882154, 27: 0.0,
    28: 0.022333453583453577, 29: 0.0017947330447330447, 30: 0.0029220779220779218, 31: 0.014411976911976907,
    32: 0.13827561327561327, 33: 0.14524711399711404, 34: 0.30407497594997596,
}
KARATE_EDGES = {
    (1, 2): 0.025252525252525245, (1, 3): 0.07778768072885714, (1, 32): 0.12725999490705367,
    (3, 33): 0.06898678663384547, (9, 34): 0.04043657867187279, (14, 34): 0.06782389723566193,
    (25, 26): 0.0042186571598336305, (27, 30): 0.004532722179781003, (32, 34): 0.053393882805647525,
    (33, 34): 0.008225108225108224,
}
KARATE_REMOVALS = [
    (1, 32, 0.12725999490705373), (1, 3, 0.11924273983097512), (1, 9, 0.13782067605597018),
    (14, 34, 0.14617273782105492), (20, 34, 0.21966651886437982), (3, 33, 0.17861952861952862),
    (2, 31, 0.2560195795489913), (2, 3, 0.1947415329768271), (3, 4, 0.1919191919191919),
    (3, 8, 0.25445632798573975), (3, 14, 0.5080213903743316),
]

# Ten vertices as adjacency lines, and their scores.
TEN = ["0 8", "1 3 7 9 2", "2 8 1 4", "3 4 5 1", "4 2 3", "5 3 6", "6 7 5", "7 1 6", "8 2 0 9", "9 1 8"]
TEN_RAW = [0, Fr(101, 6), Fr(28, 3), Fr(25, 3), Fr(7, 3), 2, 1, 5, Fr(53, 6), Fr(13, 3)]
TEN_ENDPOINTS = [
    Fr(1, 4), Fr(155, 216), Fr(55, 108), Fr(13, 27), Fr(17, 54), Fr(11, 36), Fr(5, 18), Fr(7, 18), Fr(107, 216), Fr(10, 27),
]
TEN_DIRECTED = [
    0, Fr(101, 216), Fr(7, 27), Fr(25, 108), Fr(7, 108), Fr(1, 18), Fr(1, 36), Fr(5, 36), Fr(53, 216), Fr(13, 108),
]
TEN_WEIGHTED = [0, Fr(1, 2), Fr(4, 9), Fr(1, 6), Fr(1, 12), Fr(1, 36), Fr(1, 36), Fr(1, 6), Fr(2, 9), 0]
TEN_PIVOTS = [
    0, Fr(395, 648), Fr(25, 81), Fr(5, 72), Fr(55, 648), Fr(5, 108), Fr(5, 108), Fr(5, 108), Fr(25, 54), Fr(115, 648),
]
TEN_WEIGHTED_EDGES = {
    (0, 8): Fr(1, 5), (1, 2): Fr(17, 45), (1, 3): Fr(8, 45), (1, 7): Fr(13, 45), (1, 9): Fr(7, 45), (2, 4): Fr(2, 9),
    (2, 8): Fr(14, 45), (3, 4): Fr(1, 9), (3, 5): Fr(8, 45), (5, 6): Fr(1, 15), (6, 7): Fr(8, 45), (8, 9): Fr(2, 45),
}

# Trees and the scores of their edges.
TREES = [
    ({(0, 1): 1}),
    ({(0, 1): Fr(2, 3), (1, 2): Fr(2, 3)}),
    ({(0, 1): Fr(1, 2), (1, 2): Fr(2, 3), (2, 3): Fr(1, 2)}),
    ({(0, 1): Fr(1, 2), (1, 2): Fr(1, 2), (1, 3): Fr(1, 2)}),
    ({(0, 1): Fr(2, 5), (0, 2): Fr(2, 5), (0, 3): Fr(2, 5), (0, 4): Fr(2, 5)}),
    ({(0, 1): Fr(2, 5), (0, 2): Fr(2, 5), (0, 3): Fr(3, 5), (3, 4): Fr(2, 5)}),
    ({(0, 1): Fr(2, 5), (1, 2): Fr(3, 5), (2, 3): Fr(3, 5), (3, 4): Fr(2, 5)}),
]


def ten_edges():
    lines = [[int(token) for token in line.split()] for line in TEN]
    return [(line[0], target) for line in lines for target in line[1:]]


def brute_force(vertices, weights, directed):
    """Exact unscaled node and edge sums over all pairs of ends.

    ``weights`` maps pairs to lengths. Returns ``(nodes, edges)``.
    """
    steps = {pair: Fr(length) for pair, length in weights.items() if pair[0] != pair[1]}
    if not directed:
        steps.update({(w, u): length for (u, w), length in list(steps.items())})
    dist, paths = {}, {}
    for s in vertices:
        d = {s: Fr(0)}
        changed = True
        while changed:
            changed = False
            for (u, w), length in steps.items():
                if u in d and (w not in d or d[u] + length < d[w]):
                    d[w] = d[u] + length
                    changed = True
        c = {s: 1}
        for w in sorted(d, key=d.get):
            if w != s:
                c[w] = sum(c[u] for (u, x), length in steps.items() if x == w and u in d and d[u] + length == d[w])
        dist[s], paths[s] = d, c
    nodes = dict.fromkeys(vertices, Fr(0))
    edges = dict.fromkeys(weights, Fr(0))
    for s in vertices:
        for t in dist[s]:
            if t == s:
                continue
            whole = paths[s][t]
            for v in dist[s]:
                if v not in (s, t) and t in dist[v] and dist[s][v] + dist[v][t] == dist[s][t]:
                    nodes[v] += Fr(paths[s][v] * paths[v][t], whole)
            for (u, w), length in steps.items():
                if u in dist[s] and t in dist[w] and dist[s][u] + length + dist[w][t] == dist[s][t]:
                    key = (u, w) if (u, w) in edges else (w, u)
                    edges[key] += Fr(paths[s][u] * paths[w][t], whole)
    return nodes, edges
