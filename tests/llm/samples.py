"""Sentences with personal data that no base pattern finds, and with what only looks like it: (text, spans of kind, start, end)."""

import random

NAMES = "jane.doe miller peter_k anna-lena j.smith42 office sales carla".split()
HOSTS = "example acme-corp mail.uni-bonn northwind post".split()
ENDINGS = "com org de fr co.uk jp br info".split()
CARDS = ["4111{0}1111{0}1111{0}1111", "5500{0}0000{0}0000{0}0004", "4012{0}8888{0}8888{0}1881", "6011{0}0009{0}9013{0}9424"]


def personal(rng):
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    name, host, end = rng.choice(NAMES), rng.choice(HOSTS), rng.choice(ENDINGS)
    return rng.choice([
        ("email", f"{name} (at) {host}.{end}"), ("email", f"{name}[at]{host}[dot]{end}"), ("email", f"{name} AT {host} DOT {end.split('.')[-1]}"), ("email", f"{name} at {host} dot {end.split('.')[-1]}"),
        ("phone", f"({rng.randrange(200, 999)}) {n(3)}-{n(4)}"), ("phone", f"0{rng.randrange(10, 99)} / {n(4)} {n(3)}"), ("phone", f"0{rng.randrange(1, 9)} {n(2)} {n(2)} {n(2)} {n(2)}"), ("phone", f"0049 {rng.randrange(20, 99)} {n(4)} {n(3)}"),
        ("card", rng.choice(CARDS).format(rng.choice("./_"))), ("ip", f"{rng.randrange(11, 99)}[.]{n(2)}[.]{n(2)}[.]{rng.randrange(1, 255)}"), ("ip", "2001:db8:85a3:" + ":".join(f"{rng.randrange(65536):x}" for _ in range(5))),
    ])


def plain(rng):
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    return rng.choice([
        "we met at the dot com boom", "arrived at this dot com party", f"part {n(3)}-{n(3)}-{n(4)}", f"version {n(3)}.{n(3)}.{n(4)}", f"order 0{n(3)} {n(3)} {n(4)}", "on 01.02.2024 12 came", "see icons (at) home dot png",
        f"x{n(3)}.{n(3)}.{n(4)}y", f"{n(3)} {n(3)} people", f"serial 0{n(2)}-{n(4)}-{n(3)}", "12[.]5 percent", "ratio 1:2:3:4:5:6:7 as given", f"{n(4)}.{n(4)}",
    ])


CUES = {"email": ["mail me: ", "contact ", "", "or "], "phone": ["call ", "phone: ", "", "and "], "card": ["card ", "visa ", "", "paid by "], "ip": ["server ", "from ", "", "host "]}


def sentences(seed, count):
    rng, out = random.Random(seed), []
    for _ in range(count):
        text, spans = "", []
        for _ in range(rng.randrange(1, 4)):
            text += rng.choice(["Then some words. ", "Ein Satz davor. ", "And more: ", "So; "])
            if rng.random() < 0.6:
                kind, part = personal(rng)
                text += rng.choice(CUES[kind])
                spans.append((kind, len(text), len(text) + len(part)))
                text += part + ". "
            else:
                text += plain(rng) + ". "
        out.append((text, spans))
    return out
