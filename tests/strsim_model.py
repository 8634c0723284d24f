"""Plain Python models of the string measures, used only to check the Spark
expressions on small inputs (brute force)."""


def jaro(a: str, b: str) -> float:
    la, lb = len(a), len(b)
    if la == 0 and lb == 0:
        return 1.0
    if la == 0 or lb == 0:
        return 0.0
    reach = max(max(la, lb) // 2 - 1, 0)
    bflags = [False] * lb
    amatch = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(lb, i + reach + 1)):
            if not bflags[j] and b[j] == ch:
                bflags[j] = True
                amatch.append(ch)
                break
    m = len(amatch)
    if m == 0:
        return 0.0
    bmatch = [b[j] for j in range(lb) if bflags[j]]
    t = sum(1 for x, y in zip(amatch, bmatch) if x != y) // 2
    return (m / la + m / lb + (m - t) / m) / 3.0


def jaro_winkler(a: str, b: str) -> float:
    s = jaro(a, b)
    if s > 0.7:
        p = 0
        for x, y in zip(a[:4], b):
            if x != y:
                break
            p += 1
        return s + 0.1 * p * (1 - s)
    return s
