"""Array kernels for what depends on visiting order, on dense tiles (0 is void)."""

from __future__ import annotations

import numpy as np

from pointweave.schema import ACCEPTED, GROUND, IN_ONE, OBJECT, TEMP


def unite(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index connected with each of n items by edges a-b: hook to the smaller root, then halve paths."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def neighbour_pairs(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Flat indices of neighbouring cells that are both in the mask."""
    ids = np.arange(mask.size).reshape(mask.shape)
    parts = []
    h, w = mask.shape
    for dj, di in ((0, 1), (1, 0), *(((1, 1), (1, -1)) if diagonal else ())):
        p = (slice(0, h - dj), slice(max(0, -di), w - max(0, di)))
        q = (slice(dj, h), slice(max(0, di), w - max(0, -di)))
        both = mask[p] & mask[q]
        parts.append((ids[p][both], ids[q][both]))
    return np.concatenate([p for p, _ in parts]), np.concatenate([q for _, q in parts])


def fill(z: np.ndarray, smooth: bool = False, levels: int | None = None) -> np.ndarray:
    """Multigrid void filling of a dense raster."""
    stack = [z.astype(np.int64)]
    while (levels is None or len(stack) <= levels) and min(stack[-1].shape) >= 2 and (stack[-1] == 0).any():
        low = stack[-1]
        h, w = low.shape[0] // 2, low.shape[1] // 2
        pad = np.pad(low, ((0, 2), (0, 2)))
        total, count = np.zeros((h, w), np.int64), np.zeros((h, w), np.int64)
        for j in range(3):
            for i in range(3):
                part = pad[j : j + 2 * h : 2, i : i + 2 * w : 2]
                total += part
                count += part != 0
        stack.append(np.where(count > 0, total // np.maximum(count, 1), 0))
    for k in range(len(stack) - 2, -1, -1):
        own, above = stack[k], stack[k + 1]
        h, w = own.shape
        if smooth:
            pad = np.zeros((2 * above.shape[0] + 3, 2 * above.shape[1] + 3), np.int64)
            wide = np.repeat(np.repeat(above, 2, 0), 2, 1)
            known = np.zeros((h + 2, w + 2), np.int64)
            hh, ww = min(h + 1, wide.shape[0]), min(w + 1, wide.shape[1])
            known[1 : 1 + hh, 1 : 1 + ww] = wide[:hh, :ww]
            known[1 : h + 1, 1 : w + 1] = np.where(own != 0, own, known[1 : h + 1, 1 : w + 1])
            total, weight = np.zeros((h, w), np.int64), np.zeros((h, w), np.int64)
            for j in range(3):
                for i in range(3):
                    part, share = known[j : j + h, i : i + w], 2 if 1 in (i, j) else 1
                    total += share * part
                    weight += share * (part != 0)
            stack[k] = np.where((own == 0) & (weight > 0), total // np.maximum(weight, 1), own)
        else:
            rows, cols = np.minimum(np.arange(h) // 2, above.shape[0] - 1), np.minimum(np.arange(w) // 2, above.shape[1] - 1)
            stack[k] = np.where(own == 0, above[np.ix_(rows, cols)], own)
    return stack[0]


def shifted(z: np.ndarray, dj: int, di: int) -> np.ndarray:
    """Value at (row + dj, col + di), clamped to the edge."""
    h, w = z.shape
    return z[np.ix_(np.clip(np.arange(h) + dj, 0, h - 1), np.clip(np.arange(w) + di, 0, w - 1))]


def step_cells(z: np.ndarray, reach: int, threshold: float) -> np.ndarray:
    out = np.zeros(z.shape, bool)
    for j in (-reach, 0, reach):
        for i in (-reach, 0, reach):
            one, two = shifted(z, j, i), shifted(z, 2 * j, 2 * i)
            out |= (one != 0) & (z - 2 * one + two > threshold)
    return out


def window_any(mask: np.ndarray, r: int = 1) -> np.ndarray:
    h, w = mask.shape
    pad, out = np.pad(mask, r), np.zeros((h, w), bool)
    for j in range(2 * r + 1):
        for i in range(2 * r + 1):
            out |= pad[j : j + h, i : i + w]
    return out


def extend_cells(z: np.ndarray, labelled: np.ndarray, rounds: int, threshold: float) -> np.ndarray:
    """Grow labels into neighbours that are not much lower and stand above some neighbour of their own."""
    h, w = z.shape
    half, out = threshold / 2.0, labelled.copy()
    tall = np.zeros((h, w), bool)
    for j in (-1, 0, 1):
        for i in (-1, 0, 1):
            tall |= z - shifted(z, j, i) > half
    for _ in range(rounds):
        inner = np.zeros((h, w), bool)
        inner[1:-1, 1:-1] = out[1:-1, 1:-1]
        near = np.zeros((h, w), bool)
        for j in (-1, 0, 1):
            for i in (-1, 0, 1):
                from_ = np.roll(inner, (j, i), (0, 1))  # inner cells never touch the edge, so nothing wraps
                near |= from_ & (np.roll(z, (j, i), (0, 1)) - z < half)
        out |= near & tall
    return out


def grow_groups(labels: np.ndarray, z: np.ndarray, dz: float, cap: float) -> tuple[np.ndarray, list[list[int]]]:
    """Region growing by waves: neighbours of similar height join; a group ends after the wave that passes the cap.
    Returns labels (ids from 2) and [id, ymin, ymax, xmin, xmax, count] per group."""
    out, (h, w) = labels.copy(), labels.shape
    flat, heights = out.ravel(), z.ravel().astype(np.float64)
    reach = [(j, i) for j in (-1, 0, 1) for i in (-1, 0, 1) if (i, j) != (0, 0)]
    groups = []
    seeds = np.flatnonzero(flat <= 1)
    next_id = 2
    for seed in seeds:
        if flat[seed] > 1:
            continue
        flat[seed] = next_id
        wave, members = np.array([seed]), [np.array([seed])]
        count = 1
        while len(wave) and count <= cap:
            found = []
            for j, i in reach:
                row, col = wave // w + j, wave % w + i
                ok = (row >= 0) & (row < h) & (col >= 0) & (col < w)
                to = row[ok] * w + col[ok]
                to = to[(flat[to] <= 1) & (np.abs(heights[to] - heights[wave[ok]]) <= dz)]
                if len(to):
                    to = np.unique(to)
                    flat[to] = next_id
                    found.append(to)
            wave = np.concatenate(found) if found else np.zeros(0, np.int64)
            if len(wave):
                members.append(wave)
                count += len(wave)
        own = np.concatenate(members)
        rows, cols = own // w, own % w
        groups.append([next_id, int(rows.min()), int(rows.max()), int(cols.min()), int(cols.max()), count])
        next_id += 1
    return out, groups


def _ends(mask: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each line has a marked cell, and its first and last one."""
    n = mask.shape[axis]
    return mask.any(axis), mask.argmax(axis), n - 1 - np.flip(mask, axis).argmax(axis)


def fill_inside(new: np.ndarray, labels: np.ndarray, z: np.ndarray, group: list[int], reach: int) -> None:
    """Mark in ``new`` what an object's outline encloses above the ground beside it: rows first, confirmed by columns."""
    label, y0, y1, x0, x1, _ = group
    h, w = labels.shape
    ya, yb, xa, xb = max(0, y0 - 1), min(h - 1, y1 + 1), max(0, x0 - 1), min(w - 1, x1 + 1)
    box = labels[ya : yb + 1, xa : xb + 1] == label
    some, first, last = _ends(box, 1)
    first, last = first + xa, last + xa
    for at_edge, column, ends in ((x0 - 1 <= 0, 0, first), (x1 + 1 >= w - 1, w - 1, last)):
        if at_edge:
            marked = np.flatnonzero(labels[ya : yb + 1, column] == label)
            if len(marked):  # rows between the marked edge cells reach the edge
                between = slice(marked[0], marked[-1] + 1)
                ends[between] = column
    for k in np.flatnonzero(some | ((first == 0) & (x0 - 1 <= 0)) | ((last == w - 1) & (x1 + 1 >= w - 1))):
        a, b, row = int(first[k]), int(last[k]), ya + k
        if not some[k]:  # only an edge makes this row part of the object; both ends have to be known
            continue
        if a == 0 and b == w - 1:
            continue
        beside = [int(z[row, b + 1])] if a == 0 else [int(z[row, a - 1])] if b == w - 1 else [int(z[row, a - 1]), int(z[row, b + 1])]
        own, mark, high = labels[row, a : b + 1] == label, new[row, a : b + 1], z[row, a : b + 1] > max(beside)
        free = mark != OBJECT
        mark[high & ~own & free] = IN_ONE
        mark[~high & own & free] = GROUND
    some, first, last = _ends(box, 0)
    for k in np.flatnonzero(some):
        a, b, col = int(first[k]) + ya, int(last[k]) + ya, xa + k
        if a == 0 and b == h - 1:
            continue
        beside = [int(z[b + 1, col])] if a == 0 else [int(z[a - 1, col])] if b == h - 1 else [int(z[a - 1, col]), int(z[b + 1, col])]
        mark = new[a : b + 1, col]
        hit = (z[a : b + 1, col] > max(beside)) & ((labels[a : b + 1, col] == label) | (mark == IN_ONE)) & (mark != OBJECT)
        mark[hit] = ACCEPTED
    ga, gb, gc, gd = max(0, ya - reach), min(h, yb + 1 + reach), max(0, xa - reach), min(w, xb + 1 + reach)
    wide = np.zeros((gb - ga, gd - gc), bool)
    wide[ya - ga : yb + 1 - ga, xa - gc : xb + 1 - gc] = new[ya : yb + 1, xa : xb + 1] == ACCEPTED
    area = new[ga:gb, gc:gd]
    area[window_any(wide, reach) & (area != ACCEPTED)] = TEMP  # finished objects nearby are taken over too
    y0, y1, x0, x1 = max(0, y0 - reach - 1), min(h - 1, y1 + reach + 1), max(0, x0 - reach - 1), min(w - 1, x1 + reach + 1)
    area = new[y0 : y1 + 1, x0 : x1 + 1]
    area[area == TEMP] = ACCEPTED
    area = new[max(0, y0 - 1) : y1 + 2, max(0, x0 - 1) : x1 + 2]
    area[area == label] = GROUND
    area[area == ACCEPTED] = OBJECT


def classify_ground(surface: np.ndarray, terrain: np.ndarray, gsd: float, reach: int, dz: int) -> tuple[np.ndarray, np.ndarray]:
    """Five rounds of finding objects in the terrain, voiding them and filling. Returns terrain and labels (1 or GROUND)."""
    terrain = fill(terrain)
    void = np.zeros(terrain.shape, bool)
    for k in range(5):
        edge = extend_cells(terrain, step_cells(terrain, reach, dz), reach, dz)
        labels, groups = grow_groups(np.where(edge, OBJECT, GROUND).astype(np.int64), terrain, dz, int(10000 / (gsd * gsd)))
        new = labels.copy()
        for g in groups:
            fill_inside(new, labels, terrain, g, reach)
        void |= new != GROUND
        terrain = fill(np.where(void, 0, terrain), smooth=k == 4)
    lower = (terrain >= surface) & (surface != 0)
    terrain = np.where(lower, surface, terrain)
    void &= ~lower
    void |= remove_spikes(terrain, dz / 2.0)
    terrain = fill(np.where(void, 0, terrain), smooth=True)
    return terrain, np.where(void, OBJECT, GROUND)


def remove_spikes(terrain: np.ndarray, limit: float) -> np.ndarray:
    """Void, in place and in raster order, cells that stand over all eight (clamped) neighbours. A removed cell counts as
    0 for those after it, so only cells that can be spikes on their own or beside one are looked at again."""
    gone, (h, w) = np.zeros(terrain.shape, bool), terrain.shape
    drop = lambda j, i: min(terrain[j, i] - terrain[min(max(j + a, 0), h - 1), min(max(i + b, 0), w - 1)] for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0))
    least = np.min([terrain - shifted(terrain, a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)], axis=0)
    todo = {int(i) for i in np.flatnonzero(least > limit)}
    import heapq

    queue = sorted(todo)
    while queue:
        at = heapq.heappop(queue)
        j, i = divmod(at, w)
        if drop(j, i) > limit:
            gone[j, i], terrain[j, i] = True, 0
            for a, b in ((0, 1), (1, -1), (1, 0), (1, 1)):
                if j + a < h and 0 <= i + b < w and (to := (j + a) * w + i + b) not in todo:
                    todo.add(to)
                    heapq.heappush(queue, to)
    return gone


def refine_objects(surface: np.ndarray, terrain: np.ndarray, labels: np.ndarray, gsd: float, dz: int, agl: int, area: float) -> np.ndarray:
    """Keep labels that are high, bounded by steps, wide and large enough. Returns labels (1 or GROUND)."""
    labels = np.where((labels != GROUND) & ((surface == 0) | (surface - terrain < agl)), GROUND, labels)
    labels = np.where(labels != GROUND, OBJECT, GROUND).astype(np.int64) if (labels == GROUND).any() else np.full(labels.shape, OBJECT, np.int64)
    labels, groups = grow_groups(labels, surface, dz // 2, np.inf)
    order = np.argsort(labels.ravel(), kind="stable")
    ids = labels.ravel()[order]
    h, w = labels.shape
    for g in groups:  # in order: a rejected object is ground for those after it
        own = order[np.searchsorted(ids, g[0]) : np.searchsorted(ids, g[0], "right")]
        row, col = own // w, own % w
        total = count = 0
        for j in (-1, 0, 1):
            for i in (-1, 0, 1):
                r1, c1 = np.clip(row + j, 0, h - 1), np.clip(col + i, 0, w - 1)
                ground = labels[r1, c1] == GROUND
                if ground.any():
                    r2, c2 = np.clip(row + 2 * j, 0, h - 1)[ground], np.clip(col + 2 * i, 0, w - 1)[ground]
                    z1 = surface[r1, c1][ground]
                    step = np.maximum(0, surface[row, col][ground] - z1) - np.maximum(0, z1 - surface[r2, c2])
                    total += int(np.maximum(0, step).sum())
                    count += int(ground.sum())
        if count and 0 < total / count < dz / 2.0:
            labels[row, col] = GROUND
    on = labels != GROUND
    solid = on & ~window_any(~on)
    on &= window_any(solid)
    root = unite(on.size, *neighbour_pairs(on))
    size = np.bincount(root[on.ravel()], minlength=on.size)
    on &= (size[root] >= int(area / (gsd * gsd))).reshape(on.shape)
    return np.where(on, OBJECT, GROUND)
