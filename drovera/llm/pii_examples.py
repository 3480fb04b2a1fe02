"""A small labelled table for the personal-data model: sentences made from templates and a seed."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

#: Rows of the table that ``examples`` makes unless told otherwise.
ROWS = 1200

TEMPLATES = (
    "Please write to {email} before Friday.", "Contact: {email}", "mail {email} or call {phone}", "Son adresse est {email}.",
    "Sie erreichen uns unter {email} oder {phone}.", "escriba a {email} por favor", "the sender {email} was blocked",
    "Call {phone} now!", "Phone: {phone}", "Tel. {national} (mornings)", "tel: {national}", "Telefon {national} werktags",
    "téléphone {national} le matin", "teléfono {national} de lunes a viernes", "mobile {national}", "call me at {national} tonight",
    "fax {phone} or {national}", "dial {phone} %%%", "the {phone} rethsh on toon",
    "Card number {card} was charged.", "paid with {card} on Monday", "visa {card}", "Karte {card} gesperrt", "tarjeta {card} caducada",
    "and thndly {card} stth with", "carte {card} refusée",
    "login from {ip} failed", "host {ip} did not answer", "die Adresse {ip} ist gesperrt", "desde {ip} a las", "le serveur {ip} répond", "Inwhst {ip} ored the",
    "My name is {person}.", "my name is {person} and I live here", "Dear Mr. {person}, thank you", "Mrs. {person} called", "Ms {person} left",
    "Dr. {person} will see you", "signed by Dr. {person} today", "Herr {person} kommt", "Frau {person} ist da", "Sehr geehrte Frau {person},",
    "Monsieur {person} est venu", "Madame {person} a écrit", "Je m'appelle {person}.", "Ich heiße {person} und wohne hier", "el señor {person} vive aquí",
    "la señora {person} llamó", "me llamo {person}.", "Name: {person}", "Nom: {person}", "Nombre: {person}",
    "token = \"{key}\"", "api_key = \"{key}\"", "secret: {key}", "password = \"{key}\" # do not share", "and the token = \"{key}\" of them", "API_KEY={key}", "TOKEN = \"{key}\"!!",
    "IBAN {iban} at the bank", "Konto {iban} bitte", "transfer to {iban} today", "cuenta {iban} gracias",
)

#: Sentences without personal data, many of them near misses.
NEGATIVES = (
    "In {year} there were {number} people in the town.", "Version {version} was released in {year}.", "see page {number} of {number}", "Section {version}. applies",
    "Apache License Version 2.0.", "order {decoy} has shipped", "and hained {decoy} a ble", "number {decoy} of the batch", "item {decoy} costs {number}", "rows {number} to {number}",
    "the name of the river is long", "The name was never found.", "Dr. is a title", "call it a day", "the token was lost", "a password is needed", "the key is under the mat",
    "der Name des Flusses ist lang", "le nom de la ville est beau", "el nombre de la ciudad", "Frau und Mann gehen", "phone calls are free", "Telefon und Fax",
    "on {year}-{two}-{two} it rained", "at {two}:{two} we left", "it costs {number}.{two} dollars", "{number} + {number} = {number}", "x = {number}", "name = \"{word}\"", "title: {word}",
    "Erst tion erwhwhhe sh ntores. The thinwhea of thoring", "La ciónes que de los. Un del", "### reble%%% of&&& anntre$$$", "part no {two}-{number}", "ratio {version}:{two}",
    "visa rules changed in {year}", "card games are fun", "the card {decoy} was refused", "commit {short} fixed it", "chapter {two}.", "room {number}, floor {two}", "ISBN {isbn}",
    "{ipv}", "build {ipv} of {year}", "a mobile home", "die Karte der Stadt", "api calls cost {number}", "secret garden", "IBAN is a number", "the account was closed",
)

GIVEN = "Anna Jonas Marie Pablo Lucía Peter Ingrid Omar Wei Fatima José Élodie Karl Susan Tom Grace Ivan Noor Hugo Ada".split()
FAMILY = "Keller Martin García Dubois Schmidt Okafor Chen O'Neill Rossi Novak Weber López Moreau Lindqvist Haddad Smith Jones Petrov Sato Braun".split()


def luhn(digits: str) -> bool:
    """Whether the last digit checks the others."""
    odd = sum(int(d) for d in digits[-1::-2])
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _fill(slot: str, rng: random.Random) -> str:
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 9)))
    if slot == "email":
        local = rng.choice([word(), f"{word()}.{digits(2)}", f"{word()}.{word()}", f"{word()}_{digits(3)}", word().title()])
        return f"{local}@{rng.choice([word(), f'mail{digits(1)}.{word()}'])}.{rng.choice(['com', 'org', 'de', 'fr', 'es', 'co.uk'])}"
    if slot == "phone":
        return rng.choice([f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"+{rng.randint(20, 99)} {digits(2)} {digits(4)} {digits(4)}", f"+{rng.randint(20, 99)} {digits(3)} {digits(7)}"])
    if slot == "national":
        return rng.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"0{digits(2)} {digits(4)} {digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"0{digits(3)}/{digits(7)}"])
    if slot in ("card", "decoy"):
        n = rng.choice([14, 15, 16, 16, 16, 16, 19])
        while True:
            found = digits(n)
            if luhn(found) == (slot == "card"):
                break
        if n == 16 and slot == "card" and rng.random() < 0.4:
            return rng.choice(" -").join(found[i : i + 4] for i in range(0, 16, 4))
        return found
    if slot == "ip":
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if slot == "ipv":
        return f"{rng.randint(300, 900)}.{rng.randint(0, 255)}.{rng.randint(260, 999)}.{rng.randint(0, 9)}"
    if slot == "person":
        return rng.choice([f"{rng.choice(GIVEN)} {rng.choice(FAMILY)}", rng.choice(FAMILY), f"{rng.choice(GIVEN)} {rng.choice(GIVEN)} {rng.choice(FAMILY)}"])
    if slot == "key":
        n, letters = rng.choice([20, 32, 40, 40, 64]), rng.choice(["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"])
        return "".join(rng.choice(letters) for _ in range(n - 4)) + rng.choice(letters[:10]) + "7" + rng.choice(letters[10:]) + "2"
    if slot == "iban":
        return f"{rng.choice(['DE', 'FR', 'ES', 'GB'])}{digits(2)}" + rng.choice([digits(18), " " + " ".join(digits(4) for _ in range(4)) + " " + digits(2)])
    return {
        "year": lambda: str(rng.randint(1850, 2030)), "number": lambda: digits(rng.randint(1, 6)).lstrip("0") or "7", "two": lambda: digits(2),
        "version": lambda: f"{digits(1)}.{digits(1)}" + rng.choice(["", f".{digits(1)}"]), "word": word, "short": lambda: "".join(rng.choice("0123456789abcdef") for _ in range(7)),
        "isbn": lambda: f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}",
    }[slot]()


def _noise(rng: random.Random) -> str:
    """Sentences of invented words, with line ends and now and then a number that is nobody's."""
    text = ""
    for _ in range(rng.randint(1, 3)):
        words = [_fill("word", rng) for _ in range(rng.randint(1, 7))]
        if rng.random() < 0.2:
            words.insert(rng.randrange(len(words) + 1), _fill(rng.choice(["number", "decoy", "version"]), rng))
        line = " ".join(w + ("," if rng.random() < 0.1 else "") for w in words)
        text += line[0].upper() + line[1:] + rng.choice([". ", ".\n", ". ", "\n"])
    return text.upper() if rng.random() < 0.05 else text


def sentences(rows: int = ROWS, seed: int = 11) -> list[tuple[str, str]]:
    """``(text, spans)``: spans as ``kind:start:end`` in code points, end exclusive, comma-joined."""
    rng = random.Random(seed)
    found = []
    for i in range(rows):
        pool = TEMPLATES if i % 5 < 3 else NEGATIVES
        text, spans = _noise(rng) if rng.random() < 0.5 else "", []
        template = pool[rng.randrange(len(pool))] if rng.random() < 0.8 else "{" + rng.choice(["email", "phone", "card", "ip", "decoy"]) + "}"
        if rng.random() < 0.5:
            template += rng.choice([" ", "\n", ". ", "!! "]) + _noise(rng)
        for k, piece in enumerate(re.split(r"\{(\w+)\}", template)):
            value = _fill(piece, rng) if k % 2 else piece
            kind = {"national": "phone"}.get(piece, piece)
            if k % 2 and kind in ("email", "ip", "card", "phone", "key", "person", "iban"):
                spans.append(f"{kind}:{len(text)}:{len(text) + len(value)}")
            text += value
        found.append((text, ",".join(spans)))
    return found


def examples(spark: SparkSession, rows: int = ROWS, seed: int = 11) -> DataFrame:
    """``sentences`` as a table ``(text, spans)``."""
    return spark.createDataFrame(sentences(rows, seed), "text string, spans string")
