"""A tiny sentence-at-a-time scorer, written from the published rules, to check the join-based one."""

import math
import re
import string

# Fixed values, written out here so that a slip in the operator's own lists shows.
NEGATIONS = set("""aint arent cannot cant couldnt darent didnt doesnt ain't aren't can't couldn't daren't didn't doesn't dont hadnt hasnt
havent isnt mightnt mustnt neither don't hadn't hasn't haven't isn't mightn't mustn't neednt needn't never none nope nor not nothing nowhere
oughtnt shant shouldnt uhuh wasnt werent oughtn't shan't shouldn't uh-uh wasn't weren't without wont wouldnt won't wouldn't rarely seldom
despite""".split())
STRONGER = """absolutely amazingly awfully completely considerably decidedly deeply effing enormously entirely especially exceptionally
extremely fabulously flipping flippin fricking frickin frigging friggin fully fucking greatly hella highly hugely incredibly intensely
majorly more most particularly purely quite really remarkably so substantially thoroughly totally tremendously uber unbelievably unusually
utterly very""".split()
WEAKER = "almost barely hardly kinda kindof kind-of less little marginally occasionally partly scarcely slightly somewhat sorta sortof sort-of".split()
IDIOMS = {"the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "yeah right": -2.0, "cut the mustard": 2.0, "kiss of death": -1.5,
          "hand to mouth": -2.0}

AFFIXES = [".", "!", "?", ",", ";", ":", "-", "'", '"', "!!", "!!!", "??", "???", "?!?", "!?!", "?!?!", "!?!?"]
BOOST = {**dict.fromkeys(STRONGER, 0.293), **dict.fromkeys(WEAKER, -0.293)}
PHRASES = {"just enough", "kind of", "sort of"}


def width(word):
    return len(word.encode("utf-16-le")) // 2


def bare(word):
    core = word.translate(str.maketrans("", "", string.punctuation))
    return core if width(core) > 1 and any(word in (a + core, core + a) for a in AFFIXES) else word


def words_of(text):
    return [bare(w) for w in re.split(r"[\s﻿]+", text) if width(w) > 1]


def loud(word):
    return word == word.upper() and word != word.lower()


def denies(word):
    return word.lower() in NEGATIONS or "n't" in word.lower()


def valence(words, i, lexicon, mixed):
    word = words[i]
    if word.lower() in BOOST or (word.lower() == "kind" and words[i + 1:i + 2] and words[i + 1].lower() == "of"):
        return 0.0
    if word.lower() not in lexicon:
        return 0.0
    v = lexicon[word.lower()]
    if mixed and loud(word):
        v += 0.733 if v > 0 else -0.733
    left = lambda d: words[i - d]
    for d, fade in ((1, 1.0), (2, 0.95), (3, 0.9)):
        if i < d or left(d).lower() in lexicon:
            continue
        if left(d).lower() in BOOST:
            s = BOOST[left(d).lower()] * (-1 if v < 0 else 1)
            if mixed and loud(left(d)):
                s += 0.733 if v > 0 else -0.733
            v += s * fade
        if d == 2 and left(2) == "never" and left(1) in ("so", "this"):
            v *= 1.5
        elif d == 3 and ((left(3) == "never" and left(2) in ("so", "this")) or left(1) in ("so", "this")):
            v *= 1.25
        elif denies(left(d)):
            v *= -0.74
        if d == 3:
            spans = [words[i - 1:i + 1], words[i - 2:i + 1], words[i - 2:i], words[i - 3:i], words[i - 3:i - 1]]
            hits = [IDIOMS[" ".join(s)] for s in spans if " ".join(s) in IDIOMS]
            v = hits[0] if hits else v
            for s in (words[i:i + 2], words[i:i + 3]):
                v = IDIOMS.get(" ".join(s), v)
            if " ".join(words[i - 3:i - 1]) in PHRASES or " ".join(words[i - 2:i]) in PHRASES:
                v -= 0.293
    if i > 0 and left(1).lower() == "least" and "least" not in lexicon:
        if i == 1 or left(2).lower() not in ("at", "very"):
            v *= -0.74
    return v


def half_up(x, places):
    return math.floor(x * 10 ** places + 0.5) / 10 ** places


def score(text, lexicon):
    words = words_of(text)
    if not words:
        return 0.0, 0.0, 0.0, 0.0
    caps = sum(map(loud, words))
    mixed = 0 < caps < len(words)
    values = [valence(words, words.index(w), lexicon, mixed) for w in words]
    lows = [w.lower() for w in words]
    if "but" in lows:
        at = lows.index("but")
        values = [v * (0.5 if i < at else 1.5 if i > at else 1) for i, v in enumerate(values)]
    asks = text.count("?")
    emphasis = min(text.count("!"), 4) * 0.292 + (0 if asks < 2 else asks * 0.18 if asks < 4 else 0.96)
    total = sum(values)
    total += emphasis if total > 1e-9 else -emphasis if total < -1e-9 else -total
    pos = sum(v + 1 for v in values if v > 0)
    neg = sum(1 - v for v in values if v < 0)
    neu = sum(v == 0 for v in values)
    if pos - neg > 1e-9:
        pos += emphasis
    elif neg - pos > 1e-9:
        neg += emphasis
    whole = pos + neg + neu
    return (half_up(neg / whole, 3), half_up(neu / whole, 3), half_up(pos / whole, 3),
            half_up(total / math.sqrt(total * total + 15), 4))
