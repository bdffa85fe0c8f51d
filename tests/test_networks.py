"""Communities by levels, searches with their paths, and the shared cut, against plain versions on small graphs."""

import random
from collections import Counter, defaultdict, deque

import pytest

from quillmart.operators import communities, cuts, graph, networks, paths
from quillmart.operators.flows import Network


def weights(edges):
    out = defaultdict(Counter)
    for a, b, w in edges:
        out[a][b] += w
        out[b][a] += w
    return out


def plain_modularity(edges, of):
    near = weights(edges)
    total, inside, mass = sum(sum(n.values()) for n in near.values()), Counter(), Counter()
    for a, n in near.items():
        mass[of[a]] += sum(n.values())
        inside[of[a]] += sum(w for b, w in n.items() if of[b] == of[a])
    return sum(inside[c] / total - (mass[c] / total) ** 2 for c in mass)


def plain_communities(edges, seed):
    """One node after the other in random order to the best community, then communities as nodes, until nothing moves."""
    near, r = weights(edges), random.Random(seed)
    total, place, loops = sum(sum(n.values()) for n in near.values()), {n: n for n in near}, Counter()
    while True:
        k = {n: sum(near[n].values()) + 2 * loops[n] for n in near}
        of, mass, moved, ever = {n: n for n in near}, Counter(k), True, False
        while moved:
            moved = False
            for n in r.sample(sorted(near), len(near)):
                mass[of[n]] -= k[n]
                links = Counter({of[n]: 0.0})
                for b, w in near[n].items():
                    links[of[b]] += w
                worth = {c: w - k[n] * mass[c] / total for c, w in links.items()}
                best = max(worth, key=worth.get)
                if worth[best] > worth[of[n]] + 1e-9:
                    of[n], moved, ever = best, True, True
                mass[of[n]] += k[n]
        if not ever:
            return place
        place = {n: of[p] for n, p in place.items()}
        above, inner = defaultdict(Counter), Counter()
        for n in near:
            inner[of[n]] += loops[n]
            above[of[n]].update({})
            for b, w in near[n].items():
                if of[b] == of[n]:
                    inner[of[n]] += w / 2
                else:
                    above[of[n]][of[b]] += w
        near, loops = above, inner


def is_connected(near, nodes):
    seen, todo = {nodes[0]}, [nodes[0]]
    while todo:
        for b in near[todo.pop()]:
            if b in nodes and b not in seen:
                seen.add(b)
                todo.append(b)
    return len(seen) == len(nodes)


@pytest.mark.parametrize(("seed", "groups", "inside", "outside"), [(1, 12, 0.2, 0.01), (2, 1, 0.01, 0.01)])
def test_communities_are_as_good_as_plain_ones(spark, seed, groups, inside, outside):
    r = random.Random(seed)
    edges = [(f"n{i}", f"n{j}", 1.0 + r.random()) for i in range(500) for j in range(i) if r.random() < (inside if i % groups == j % groups else outside)]
    found = {x.node: x.community for x in communities.communities(spark.createDataFrame(edges, "source string, target string, weight double")).collect()}
    near, members = weights(edges), defaultdict(list)
    for n, c in found.items():
        members[c].append(n)
    assert set(found) == set(near) and all(is_connected(near, m) and c == min(m) for c, m in members.items())
    assert plain_modularity(edges, found) >= plain_modularity(edges, plain_communities(edges, seed)) - 0.002


def test_communities_of_odd_graphs(spark):
    """No edges, loops, parallel edges, null and zero weights, lone pairs, and nodes that stand for many."""
    kinds = "source string, target string, weight double"
    assert communities.communities(spark.createDataFrame([], kinds)).count() == 0
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("a", "a", 0.5), ("c", "d", None), ("e", "f", 0.0)], kinds)
    loops = spark.createDataFrame([("x", 3.0), ("a", 1.0)], "node string, weight double")
    assert {tuple(r) for r in communities.communities(edges, loops).collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("x", "x")}


def test_projection_of_classes_keeps_every_pair(spark):
    """Prefixes lose no pair of weighted Jaccard 0.3 or more with two shared attributes; product communities are those of the spelled-out graph in kind."""
    r = random.Random(5)
    kinds = [f"a{i}" for i in range(14)]
    rows = [(str(p), a, r.choice([75, 80, 90])) for p in range(70) for a in {r.choice(kinds[: r.randint(2, 14)]) for _ in range(r.randint(0, 6))}]
    edges = spark.createDataFrame(rows, "product_id string, attribute string, weight int")
    degree = Counter(a for _, a in {(p, a) for p, a, _ in rows})
    n = len({p for p, _, _ in rows})
    kept = {a for a, d in degree.items() if d <= max(2, int(0.35 * n))}
    own = defaultdict(dict)
    for p, a, w in rows:
        if a in kept:
            own[p][a] = max(w, own[p].get(a, 0))
    want = {}
    for x in own:
        for y in own:
            both = set(own[x]) & set(own[y])
            shared = sum(min(own[x][a], own[y][a]) for a in both)
            if x < y and len(both) >= 2 and (s := shared / (sum(own[x].values()) + sum(own[y].values()) - shared)) >= 0.3:
                want[x, y] = (len(both), shared, round(s, 9))
    got = {(x.product_a, x.product_b): (x.n_shared, x.shared_weight, round(x.similarity, 9)) for x in graph.product_projection(edges).collect()}
    assert got == want
    found = communities.product_communities(edges).collect()
    assert {x.product_id for x in found} == {p for pair in want for p in pair}
    plain = [(a, b, s) for (a, b), (_, _, s) in want.items()]
    assert plain_modularity(plain, {x.product_id: x.community for x in found}) >= plain_modularity(plain, plain_communities(plain, 1)) - 0.01


def plain_path(near, start, goal):
    before, queue = {start: None}, deque([start])
    while queue:
        n = queue.popleft()
        for b in sorted(near[n]):
            if b not in before:
                before[b] = n
                queue.append(b)
    if goal not in before:
        return None
    n, length = goal, 0
    while before[n] is not None:
        n, length = before[n], length + 1
    return length


def test_paths_are_shortest(spark):
    r = random.Random(9)
    edges = {(f"n{i}", f"n{r.randrange(60)}") for i in range(60) for _ in range(r.choice([0, 1, 2]))} | {("x", "y")}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    both = spark.createDataFrame([(a, b) for a in near for b in near[a]], "u string, v string")
    nodes = sorted(near)
    for start, goal in [*((r.choice(nodes), r.choice(nodes)) for _ in range(3)), ("n0", "n0"), ("n1", "x"), ("none", "n1")]:
        length = plain_path(near, start, goal)
        for search in (paths.shortest_path, paths.bidirectional_path):
            rows = sorted(search(both, start, goal).collect())
            walk = [x.node for x in rows]
            assert (len(walk) - 1 if walk else None) == length and [x.step for x in rows] == list(range(len(walk)))
            assert all(b in near[a] for a, b in zip(walk, walk[1:], strict=False)) and (not walk or (walk[0], walk[-1]) == (start, goal))
    star = spark.createDataFrame([p for i in range(40) for p in (("hub", f"l{i}"), (f"l{i}", "hub"))] + [("l0", "far"), ("far", "l0"), ("far", "end"), ("end", "far")], "u string, v string")
    row = paths.compare_searches(star, "l1", "end").first()
    assert (row.length, row.bfs_expanded, row.two_sided_expanded) == (4, 42, 4)
    labels = spark.createDataFrame([("l1", "Tapa roja"), ("end", "Pote"), ("hub", None)], "node_id string, label string")
    assert [x.node_id for x in sorted(paths.connection(labels, star, "tapa", "po").collect())] == ["l1", "hub", "l0", "far", "end"]
    assert paths.connection(labels, star, "tapa", "zzz").count() == 0


def test_short_texts_find_nodes(spark):
    nodes = spark.createDataFrame([("1", "AB C"), ("2", "Bolt"), ("0", "xBy")], "node_id string, label string")
    got = {x.text: x.node_id for x in networks.find_nodes(spark.createDataFrame([(t,) for t in ("b", "ab", "bo", "2", "olt", "q", "", None)], "text string"), nodes).collect()}
    assert got == {"b": "0", "ab": "1", "bo": "2", "2": "2", "olt": "2"}


def plain_cut(demand, options):
    net, wanted = Network(), {p: n for p, n in demand if n > 0 and p in {o[0] for o in options}}
    offers = [o for o in options if o[0] in wanted]
    arcs = [("SUPPLIER->PRODUCT", s, p, net.arc(("s", s), ("p", p), n)) for p, s, n, _ in offers]
    arcs += [("SOURCE->SUPPLIER", "SOURCE", s, net.arc("source", ("s", s), n)) for s, n in {s: n for _, s, _, n in offers}.items()]
    arcs += [("PRODUCT->SINK", p, "SINK", net.arc(("p", p), "sink", n)) for p, n in wanted.items()]
    net.node("sink")
    flow, side = net.saturate(), net.reached()
    return flow, sorted((k, a, b, room) for k, a, b, i in arcs if net.head[i ^ 1] in side and net.head[i] not in side and (room := net.room[i] + net.room[i ^ 1]) > 0)


def test_shared_cut_is_the_plain_one(spark):
    for seed in range(3):
        r = random.Random(seed)
        caps = {f"s{j}": r.randint(0, 40) for j in range(6)}
        demand = [(f"p{i}", r.randint(0, 30)) for i in range(10)] + [("unknown", 5)]
        options = [(f"p{i}", s, r.randint(1, 15), caps[s]) for i in range(10) for s in r.sample(list(caps), 3)]
        asked, offered = spark.createDataFrame(demand, "product_id string, ordered long"), spark.createDataFrame(options, "product_id string, supplier string, capacity_units long, supplier_capacity long")
        cut = cuts.shared_cut(asked, offered)
        flow, arcs = plain_cut(demand, options)
        row = cuts.shared_flow(asked, offered, cut).first()
        assert sorted(tuple(x) for x in cut.collect()) == arcs and row.max_flow == flow and row.products == sum(n > 0 for p, n in demand if p != "unknown")
    assert cuts.shared_cut(asked.limit(0), offered).count() == 0 and cuts.shared_cut(asked, offered.limit(0)).count() == 0


def test_personal_ranks_converge(spark):
    """Against power iteration, for all seeds at once; a seed outside the graph."""
    import numpy as np

    r = random.Random(6)
    edges = [(f"n{i}", f"n{j}", 1.0 + r.random()) for i in range(40) for j in range(i) if r.random() < 0.1] + [("x", "y", 1.0)]
    near = weights(edges)
    names = sorted(near)
    walk = np.array([[near[a][b] / sum(near[a].values()) for b in names] for a in names])
    both = spark.createDataFrame([(a, b, w) for a in near for b, w in near[a].items()], "u string, v string, w double")
    seeds = ["n3", "x", "n7"]
    got = {(x.seed, x.node): x["rank"] for x in paths.personal_ranks(both, spark.createDataFrame([(n,) for n in [*seeds, "n3", "none", None]], "node string")).collect()}
    assert got.pop(("none", "none")) == 1.0
    for seed in seeds:
        start = np.array([float(n == seed) for n in names])
        rank = start
        for _ in range(400):
            rank = 0.15 * start + 0.85 * rank @ walk
        assert max(abs(got.pop((seed, n), 0.0) - v) for n, v in zip(names, rank, strict=True)) < 1e-6
    assert not got


def test_top_similar_without_all_pairs(spark):
    """Best partners by classes equal those of the spelled-out projection, also where many products are equal."""
    r = random.Random(5)
    sets = [sorted(r.sample(range(14), r.randint(2, 5))) for _ in range(12)]
    rows = [(f"p{i:03d}", f"a{t}", 80 + t % 3) for i in range(90) for t in sets[r.randrange(12)]]
    edges = spark.createDataFrame(rows, "product_id string, attribute string, weight int")
    row = lambda df: sorted((x.product_id, x.other, round(x.similarity, 12), x["rank"]) for x in df.collect())
    assert row(graph.top_similar_products(edges)) == row(graph.top_similar(graph.product_projection(edges)))


def test_ranks_of_a_star_converge(spark):
    """A walk between two sides swings for over a hundred rounds; solved, the ranks are those that a step leaves as they are."""
    star = [("c", f"l{i}") for i in range(9)]
    both = spark.createDataFrame([*star, *[(b, a) for a, b in star]], "u string, v string").selectExpr("u", "v", "1.0D as w")
    got = {r.node: r["rank"] for r in networks.pagerank_converged(both).collect()}
    change = abs(0.015 + 0.85 * sum(got[f"l{i}"] for i in range(9)) - got["c"]) + sum(abs(0.015 + 0.85 * got["c"] / 9 - got[f"l{i}"]) for i in range(9))
    assert len(got) == 10 and change < networks.STOP


def test_betweenness_of_equal_nodes(spark, monkeypatch):
    """Against Brandes' way from every source, with many equal nodes, which take rows of their classes alone."""
    r, sizes, store = random.Random(11), [], networks.stored

    def counted(df, name):
        out = store(df, name)
        sizes.append(out.count() if name == "between-level" else 0)
        return out

    monkeypatch.setattr(networks, "stored", counted)
    hubs = [(f"h{i}", f"h{j}") for i in range(6) for j in range(i) if r.random() < 0.5 or j == i - 1]
    pairs = {*hubs, *((f"x{i}", f"h{i % 3}") for i in range(30)), *((f"y{i}", h) for i in range(12) for h in ("h1", "h4")), ("h0", "h0")}
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    both = spark.createDataFrame([(a, b) for a in near for b in near[a]], "u string, v string")
    for starts in (sorted(near), [f"x{i}" for i in range(0, 30, 2)] + ["y1", "h2", "none"]):
        want = Counter()
        for s in starts:
            far, paths_, order, queue = {s: 0}, Counter({s: 1}), [], deque([s])
            while queue:
                u = queue.popleft()
                order.append(u)
                for v in near[u] - {u} if u in near else ():
                    if v not in far:
                        far[v] = far[u] + 1
                        queue.append(v)
                    if far[v] == far[u] + 1:
                        paths_[v] += paths_[u]
            owed = Counter()
            for w in reversed(order):
                for v in near[w] if w in near else ():
                    if far[v] == far[w] - 1:
                        owed[v] += paths_[v] / paths_[w] * (1 + owed[w])
                if w != s:
                    want[w] += owed[w] / 2
        sizes.clear()
        got = {x.node: x.betweenness for x in networks.betweenness(both, spark.createDataFrame([(n,) for n in starts], "node string")).collect()}
        assert set(got) == set(near) and all(got[n] == pytest.approx(want[n]) for n in near)
        assert sum(sizes) < 300
