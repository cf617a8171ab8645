"""A hierarchical navigable small-world graph over unit vectors, searched for many queries in step."""

from __future__ import annotations

import numpy as np

_NONE = -1


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    """Column indices of the k largest of each row, in no order."""
    return np.argpartition(-sims, k - 1, axis=1)[:, :k] if sims.shape[1] > k else np.broadcast_to(np.arange(sims.shape[1]), sims.shape)


class Hnsw:
    """Layers of links; a node's layer comes from its seed, so that equal input gives an equal graph.

    ``links`` neighbours a node in the upper layers, twice as many in the lowest.
    """

    def __init__(self, vectors: np.ndarray, seeds: np.ndarray, links: int = 12, beam: int = 32, batch: int = 256) -> None:
        self.x = np.ascontiguousarray(vectors, dtype=np.float32)
        self.links, self.beam = links, beam
        n = len(self.x)
        u = (seeds.astype(np.float64) + 0.5) / 2.0**64
        self.level = np.minimum((-np.log(np.maximum(u, 1e-12)) / np.log(links)).astype(np.int64), 8)
        # nodes of the upper layers come first, so a layer is a prefix of the insertion order
        self.order = np.lexsort((seeds, -self.level))
        self.tops = [self.order[self.level[self.order] >= layer] for layer in range(int(self.level.max(initial=0)) + 1)]
        self.graph = [np.full((n, links * (2 if layer == 0 else 1)), _NONE, np.int32) for layer in range(len(self.tops))]
        for layer in range(len(self.tops) - 1, -1, -1):
            self._fill(layer, batch)

    def _fill(self, layer: int, batch: int) -> None:
        """Insert a layer's nodes batch by batch; batches at most double it."""
        nodes, done = self.tops[layer], 0
        while done < len(nodes):
            size = min(len(nodes) - done, max(32, min(batch, done)))
            new = nodes[done : done + size]
            near = self.x[new] @ self.x[new].T
            np.fill_diagonal(near, -2)
            k = min(self.beam, size)
            pick = _top(near, k)
            ids, sims = new[pick], np.take_along_axis(near, pick, 1)
            if done:
                start = self._descend(self.x[new], layer) if layer + 1 < len(self.tops) else np.full(size, nodes[0])
                found, value = self._beam(self.x[new], start, layer, self.beam)
                ids, sims = np.concatenate([ids, found], 1), np.concatenate([sims, value], 1)
            width = self.graph[layer].shape[1]
            self.graph[layer][new] = self._choose(ids, sims, width)
            self._link_back(layer, new, width)
            done += size

    def _choose(self, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
        """Neighbours by similarity, preferring those that no nearer candidate is closer to."""
        sims = np.where(ids == _NONE, -2, sims)
        order = np.argsort(-sims, axis=1, kind="stable")[:, : max(width * 3, width + 8)]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        b, c = ids.shape
        between = np.einsum("bid,bjd->bij", self.x[ids], self.x[ids])
        hidden = ((between >= sims[:, :, None]) & np.tri(c, c, -1, dtype=bool)).any(2)
        chosen = ~hidden & (sims > -2)
        # the rest fills up by similarity
        rank = np.where(chosen, 0, 1) * c + np.arange(c)
        rank = np.where(sims > -2, rank, 4 * c)
        best = np.argsort(rank, axis=1)[:, :width]
        out = np.take_along_axis(ids, best, 1)
        out = np.where(np.take_along_axis(sims, best, 1) > -2, out, _NONE)
        if out.shape[1] < width:
            out = np.concatenate([out, np.full((b, width - out.shape[1]), _NONE)], 1)
        return out.astype(np.int32)

    def _link_back(self, layer: int, new: np.ndarray, width: int) -> None:
        graph = self.graph[layer]
        to = graph[new]
        source = np.repeat(new, width)[to.ravel() != _NONE]
        target = to.ravel()[to.ravel() != _NONE]
        if not len(target):
            return
        sims = np.einsum("ij,ij->i", self.x[source], self.x[target])
        order = np.lexsort((-sims, target))
        source, target = source[order], target[order]
        hosts, first = np.unique(target, return_index=True)
        place = np.arange(len(target)) - np.repeat(first, np.diff(np.append(first, len(target))))
        keep = place < width
        extra = np.full((len(hosts), width), _NONE, np.int64)
        extra[np.searchsorted(hosts, target[keep]), place[keep]] = source[keep]
        for k in range(0, len(hosts), 512):
            some = hosts[k : k + 512]
            ids = np.concatenate([graph[some], extra[k : k + 512]], 1).astype(np.int64)
            # a node that is listed twice counts once
            ids.sort(axis=1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = _NONE
            near = np.einsum("bd,bcd->bc", self.x[some], self.x[ids])
            full = (ids != _NONE).sum(1) > width
            kept = np.where(ids == _NONE, 1, 0).argsort(axis=1, kind="stable")[:, :width]
            rows = np.take_along_axis(ids, kept, 1)
            if full.any():
                rows[full] = self._choose(ids[full], np.where(ids[full] == _NONE, -2, near[full]), width)
            graph[some] = rows

    def _descend(self, queries: np.ndarray, layer: int) -> np.ndarray:
        """Best node of the layers above for each query, by greedy steps."""
        at = np.full(len(queries), self.tops[-1][0])
        for top in range(len(self.tops) - 1, layer, -1):
            found, sims = self._beam(queries, at, top, 4)
            at = found[np.arange(len(queries)), sims.argmax(1)]
        return at

    def _beam(self, queries: np.ndarray, start: np.ndarray, layer: int, width: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and similarities of the beams of all queries."""
        q = len(queries)
        graph = self.graph[layer]
        ids = np.full((q, width), _NONE, np.int64)
        sims = np.full((q, width), -2, np.float32)
        fresh = np.zeros((q, width), bool)
        ids[:, 0] = start
        sims[:, 0] = np.einsum("ij,ij->i", queries, self.x[start])
        fresh[:, 0] = True
        seen = np.zeros((q, len(self.x)), bool)
        seen[np.arange(q), start] = True
        active = np.arange(q)
        while len(active):
            a_ids, a_sims, a_fresh = ids[active], sims[active], fresh[active]
            e = min(expand, width)
            pick = _top(np.where(a_fresh, a_sims, -9), e)
            ready = np.take_along_axis(a_fresh, pick, 1)
            node = np.where(ready, np.take_along_axis(a_ids, pick, 1), 0)
            np.put_along_axis(a_fresh, pick, False, 1)
            near = np.where(ready[:, :, None], graph[node], _NONE).reshape(len(active), -1).astype(np.int64)
            near.sort(axis=1)
            ok = near != _NONE
            ok[:, 1:] &= near[:, 1:] != near[:, :-1]
            ok &= ~seen[active[:, None], near]
            rows, cols = np.nonzero(ok)
            found = near[rows, cols]
            seen[active[rows], found] = True
            value = np.full(near.shape, -2, np.float32)
            value[rows, cols] = np.einsum("ij,ij->i", queries[active[rows]], self.x[found])
            all_ids = np.concatenate([a_ids, np.where(ok, near, _NONE)], 1)
            all_sims = np.concatenate([a_sims, value], 1)
            all_fresh = np.concatenate([a_fresh, ok], 1)
            best = _top(all_sims, width)
            ids[active] = np.take_along_axis(all_ids, best, 1)
            sims[active] = np.take_along_axis(all_sims, best, 1)
            now = np.take_along_axis(all_fresh, best, 1)
            fresh[active] = now
            active = active[now.any(1)]
        return ids, sims

    def within(self, queries: np.ndarray, least: float, width: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) with a similarity of at least ``least``.

        A beam that fills with such nodes may miss more of them; widening it to
        the whole group would visit every member anyway, so those queries are
        compared with the shard in one product.
        """
        out_q, out_n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        n = len(self.x)
        beam = min(width, n)
        for k in range(0, len(queries), block):
            some = queries[k : k + block]
            ids, sims = self._beam(some, self._descend(some, 0), 0, beam)
            full = (sims.min(1) >= least) & (beam < n)
            rows, cols = np.nonzero((sims >= least) & ~full[:, None])
            out_q.append(rows + k)
            out_n.append(ids[rows, cols])
            dense = np.flatnonzero(full)
            for at in range(0, n if len(dense) else 0, 1 << 15):
                rows, cols = np.nonzero(some[dense] @ self.x[at : at + (1 << 15)].T >= least)
                out_q.append(dense[rows] + k)
                out_n.append(cols + at)
        return np.concatenate(out_q), np.concatenate(out_n)

    def links_of(self, nodes: np.ndarray, least: float, block: int = 1 << 14) -> np.ndarray:
        """(place in nodes, other node) of at least that similarity, by products with blocks of the shard."""
        out = [np.zeros((2, 0), np.int64)]
        for k in range(0, len(nodes), 256):
            some = nodes[k : k + 256]
            for at in range(0, len(self.x), block):
                i, j = np.nonzero(self.x[some] @ self.x[at : at + block].T >= least)
                apart = some[i] != j + at
                out.append(np.stack([i[apart] + k, j[apart] + at]))
        return np.concatenate(out, axis=1)

    def fitting_beam(self, least: float, order: np.ndarray, recall: float, width: int = 12, real: int = 200, most: int = 4096) -> int:
        """Smallest doubled beam that recalls the audited nodes' links to others.

        Nodes are audited in the given order, in growing samples, until they have
        ``real`` links or ``most`` nodes were taken. With fewer links the beam is
        four times as wide as the last that passed.
        """
        size, done = min(128, len(order)), 0
        links = [np.zeros((2, 0), np.int64)]
        while done < size:
            links.append(self.links_of(order[done:size], least) + np.array([[done], [0]]))
            done = size
            if sum(x.shape[1] for x in links) < real:
                size = min(2 * size, most, len(order))
        sample, (asker, other) = order[:done], np.concatenate(links, axis=1)
        n, truth = len(asker), asker * len(self.x) + other
        while width < len(self.x) and n:
            q, node = self.within(self.x[sample], least, width)
            if np.isin(q * len(self.x) + node, truth).sum() >= recall * n:
                break
            width *= 2
        return width if n >= real else 4 * width
