"""Plain versions of what the operators compute."""


def classes(n, links):
    """The least index reachable from each of ``n``."""
    label = list(range(n))

    def top(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        label[b] = a
    return [top(i) for i in range(n)]


def shingle_set(words, n=5):
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()
