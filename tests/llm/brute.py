"""Plain, slow versions of the operators, written from their contracts."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser


def suffix_dedup(texts, window=400, keep="none"):
    data = [(t or "").encode() for t in texts]
    seen = defaultdict(list)
    for d, b in enumerate(data):
        for i in range(len(b) - window + 1):
            seen[hashlib.blake2b(b[i : i + window], digest_size=16).digest()].append((d, i))
    gone = [bytearray(len(b)) for b in data]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places[1:] if keep == "first" else places:
                gone[d][i : i + window] = b"\x01" * window
    out = []
    for b, g in zip(data, gone):
        rest = bytes(x for x, y in zip(b, g) if not y)
        out.append((len(b), sum(g), len(re.findall(b"\x01+", bytes(g))), hashlib.sha256(rest).hexdigest()))
    return out


def shared_words(texts, size=51):
    """Words in strings of `size` words that another text holds as well."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    holders = defaultdict(set)
    for d, w in enumerate(words):
        for i in range(len(w) - size + 1):
            holders[tuple(w[i : i + size])].add(d)
    return [len({j for i in range(len(w) - size + 1) if len(holders[tuple(w[i : i + size])]) > 1 for j in range(i, i + size)}) for w in words]


def quality_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if n[w] > 1:
            inside |= {i, i + 1, i + 2}
    out = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))
    return (*out, out[0] < 50 or 100 * out[4] > 50 * out[0])


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def decontaminate(docs, items, n=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
    windows = defaultdict(set)
    for item, text in items:
        if item is not None:
            w = words(text)
            for i in range(max(1, len(w) - n + 1)) if w else ():
                windows[tuple(w[i : i + n])].add(str(item))
    out = []
    for text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (x := tuple(w[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[x]
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def near_items(docs, items, slop, n=13):
    """How many items have a window of which all words lie within `slop` places of theirs, counted from the rarest word's."""
    if not slop:
        return [0] * len(docs)
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t)) for t in docs]
    count = Counter(w for ws in words for w in ws)
    found = [set() for _ in docs]
    for item, text in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
        for i in range(max(1, len(w) - n + 1)) if w and item is not None else ():
            window = w[i : i + n]
            rare = min(range(len(window)), key=lambda j: (count[window[j]], j))
            for d, ws in enumerate(words):
                for p in (p for p, x in enumerate(ws) if x == window[rare] and str(item) not in found[d]):
                    if all(any(0 <= q < len(ws) and ws[q] == x for q in range(p - rare + j - slop, p - rare + j + slop + 1)) for j, x in enumerate(window) if j != rare):
                        found[d].add(str(item))
    return [len(f) for f in found]


class _Blocks(HTMLParser):
    """Blocks of well-formed pages: (text, characters in links, in a bad container, article)."""

    BREAKS = frozenset("p div li ul h1 article nav footer body html head title style script".split())

    def __init__(self, page):
        super().__init__()
        self.out, self.stack, self.text, self.linked, self.link, self.articles = [], [], "", 0, False, 0
        self.feed(page)
        self.close()
        self.done()

    def done(self):
        text = " ".join(self.text.split())
        bad, article = any(x[1] for x in self.stack), max([x[2] for x in self.stack], default=0)
        if text:
            self.out.append((text, self.linked / len(text), bad, 0 if bad else article, any(x[0] == "h1" for x in self.stack)))
        self.text, self.linked = "", 0

    def handle_starttag(self, tag, attrs):
        if tag in self.BREAKS:
            self.done()
            while tag == "p" and self.stack and self.stack[-1][0] == "p":
                self.stack.pop()
            self.articles += tag == "article"
            self.stack.append((tag, tag in ("nav", "footer") or ("class", "ad") in attrs, self.articles if tag == "article" else 0))
        self.link = tag == "a" or (self.link and tag not in self.BREAKS)
        self.text += " " * (tag == "br")

    def handle_endtag(self, tag):
        if tag in self.BREAKS:
            self.done()
            if any(x[0] == tag for x in self.stack):
                while self.stack.pop()[0] != tag:
                    pass
        if tag == "a":
            self.link = False

    def handle_data(self, data):
        if not any(x[0] in ("style", "script", "title") for x in self.stack):
            self.text += data
            self.linked += len(data.strip()) if self.link else 0


def main_text(page):
    from quillmesh.llm.html_main import STOP_WORDS

    found = _Blocks(page).out

    def label(text, links, bad, article, _):
        if bad or links > 0.33:
            return -1
        words = re.findall(r"\w+", text.lower())
        density = len([w for w in words if w in STOP_WORDS]) / max(1, len(words))
        if len(text) < 70:
            return -1 if links and not article else "short"
        if article:
            return 1 if density >= 0.2 else "few"
        if density >= 0.3 and len(text) > 200:
            return 1
        return "nearly" if density >= 0.2 else -1

    labels = [label(*b) for b in found]
    kept = []
    for i, (b, x) in enumerate(zip(found, labels)):
        near = lambda way, same: next((labels[j] for j in (range(i - 1, -1, -1) if way < 0 else range(i + 1, len(labels))) if labels[j] in (1, -1) and (not same or found[j][3] == b[3])), 0)  # noqa: E731, B023
        if x in (1, -1):
            good = x == 1
        elif b[3]:
            some = any(y == 1 and c[3] == b[3] for y, c in zip(labels, found))
            good = not some or not near(-1, True) == near(1, True) == -1
        else:
            left, right = near(-1, False) == 1, near(1, False) == 1
            good = left and right or x == "nearly" and (left or right or 1 not in labels) or b[4] and right
        if good:
            kept.append(b[0])
    return " ".join(kept)


def shingles(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard_join(docs, percent=85, n=4):
    sets = [(i, shingles(t, n)) for i, t in docs]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if x and y and 100 * len(x & y) >= percent * len(x | y)]
    parts = components([i for i, _ in docs], links)
    return {(i, len(x), parts[i]) for i, x in sets}


def crc_of_ids(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
