"""Plain cell-by-cell models of the order-dependent operators, written apart from the array kernels."""

from pointweave.schema import ACCEPTED, GROUND, IN_ONE, OBJECT, TEMP


def around(j, i, h, w, r=1):
    return [(y, x) for y in range(max(0, j - r), min(h, j + r + 1)) for x in range(max(0, i - r), min(w, i + r + 1))]


def at(z, j, i):
    return z[min(max(j, 0), len(z) - 1)][min(max(i, 0), len(z[0]) - 1)]


def fill(z, smooth=False, levels=None):
    z = [list(map(int, r)) for r in z]
    h, w = len(z), len(z[0])
    if levels == 0 or h < 2 or w < 2 or all(v for r in z for v in r):
        return z
    up = [[0] * (w // 2) for _ in range(h // 2)]
    for j in range(h // 2):
        for i in range(w // 2):
            own = [z[y][x] for y, x in around(2 * j + 1, 2 * i + 1, h, w) if z[y][x]]
            up[j][i] = sum(own) // len(own) if own else 0
    up = fill(up, smooth, None if levels is None else levels - 1)
    out = [list(r) for r in z]
    for j in range(h):
        for i in range(w):
            if z[j][i]:
                continue
            if not smooth:
                out[j][i] = up[min(j // 2, h // 2 - 1)][min(i // 2, w // 2 - 1)]
                continue
            total = weight = 0
            for y in range(max(j - 1, 0), j + 2):
                for x in range(max(i - 1, 0), i + 2):
                    v = z[y][x] if y < h and x < w else 0
                    v = v or (up[y // 2][x // 2] if y // 2 < h // 2 and x // 2 < w // 2 else 0)
                    k = 2 if y == j or x == i else 1
                    total, weight = total + k * v, weight + k * bool(v)
            out[j][i] = total // weight if weight else 0
    return out


def grow(labels, z, dz, cap):
    h, w = len(z), len(z[0])
    out, groups = [list(r) for r in labels], []
    for j in range(h):
        for i in range(w):
            if out[j][i] > 1:
                continue
            name = len(groups) + 2
            out[j][i], wave, members = name, [(j, i)], [(j, i)]
            while wave and len(members) <= cap:
                new = []
                for a, b in wave:
                    for y, x in around(a, b, h, w):
                        if out[y][x] <= 1 and abs(z[y][x] - z[a][b]) <= dz:
                            out[y][x] = name
                            new.append((y, x))
                members += new
                wave = new
            ys, xs = [m[0] for m in members], [m[1] for m in members]
            groups.append([name, min(ys), max(ys), min(xs), max(xs), len(members)])
    return out, groups


def inside(new, labels, z, group, reach):
    """One object's interior, in place, following the written rules step by step."""
    name, y0, y1, x0, x1, _ = group
    h, w = len(z), len(z[0])

    def rows_in(col):
        hit = [j for j in range(max(0, y0 - 1), min(h - 1, y1 + 1) + 1) if labels[j][col] == name]
        return (hit[0], hit[-1]) if hit else None

    left, right = rows_in(0) if x0 - 1 <= 0 else None, rows_in(w - 1) if x1 + 1 >= w - 1 else None
    for j in range(max(0, y0 - 1), min(h - 1, y1 + 1) + 1):
        own = [i for i in range(max(0, x0 - 1), min(w - 1, x1 + 1) + 1) if labels[j][i] == name]
        if not own:
            continue
        a = 0 if left and left[0] <= j <= left[1] else own[0]
        b = w - 1 if right and right[0] <= j <= right[1] else own[-1]
        if a == 0 and b == w - 1:
            continue
        ground = max(([z[j][b + 1]] if b < w - 1 else []) + ([z[j][a - 1]] if a else []))
        for i in range(a, b + 1):
            if new[j][i] != OBJECT:
                if z[j][i] > ground and labels[j][i] != name:
                    new[j][i] = IN_ONE
                elif z[j][i] <= ground and labels[j][i] == name:
                    new[j][i] = GROUND
    for i in range(max(0, x0 - 1), min(w - 1, x1 + 1) + 1):
        ends = rows_in(i)
        if not ends or ends == (0, h - 1):
            continue
        a, b = ends
        ground = max(([z[b + 1][i]] if b < h - 1 else []) + ([z[a - 1][i]] if a else []))
        for j in range(a, b + 1):
            if z[j][i] > ground and (labels[j][i] == name or new[j][i] == IN_ONE) and new[j][i] != OBJECT:
                new[j][i] = ACCEPTED
    spread = [(y, x) for j in range(max(0, y0 - 1), min(h - 1, y1 + 1) + 1) for i in range(max(0, x0 - 1), min(w - 1, x1 + 1) + 1) if new[j][i] == ACCEPTED for y, x in around(j, i, h, w, reach)]
    for y, x in spread:
        if new[y][x] != ACCEPTED:
            new[y][x] = TEMP
    y0, y1, x0, x1 = max(0, y0 - reach - 1), min(h - 1, y1 + reach + 1), max(0, x0 - reach - 1), min(w - 1, x1 + reach + 1)
    for j in range(y0, y1 + 1):
        for i in range(x0, x1 + 1):
            if new[j][i] == TEMP:
                new[j][i] = ACCEPTED
    for j in range(max(0, y0 - 1), min(h - 1, y1 + 1) + 1):
        for i in range(max(0, x0 - 1), min(w - 1, x1 + 1) + 1):
            new[j][i] = GROUND if new[j][i] == name else OBJECT if new[j][i] == ACCEPTED else new[j][i]


def spikes(z, limit):
    z = [list(r) for r in z]
    gone = []
    for j in range(len(z)):
        for i in range(len(z[0])):
            if min(max(0, z[j][i] - at(z, j + a, i + b)) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)) > limit:
                z[j][i] = 0
                gone.append((j, i))
    return gone
