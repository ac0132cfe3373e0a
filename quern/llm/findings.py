"""Labelled findings for the secret scan: lines as people write them, with their secrets marked.

No reviewed findings come with the supplied tables, so these stand in: every
line is made from a form (what kind of string) and a setting (where it is
written).  The scan cuts them with its own scanner, as it cuts documents, and
learns from what it has cut; nothing here is known to the scan otherwise.
Settings and names are shared by secrets and by strings that merely look alike.
"""

from __future__ import annotations

import base64
import random
from collections.abc import Callable
from typing import NamedTuple

_UPPER, _LOWER, _DIGITS, _HEX = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
_ALNUM = _UPPER + _LOWER + _DIGITS

WORDS = (
    "account adapter archive backup billing branch builder cache canvas center client cloud cluster column commit config connect content counter "
    "cursor dashboard default deploy device document domain driver editor engine event export factory feature filter folder format gateway handler "
    "header history image import index input invoice item journal kernel label layout legacy library listener loader locale logger mail manager "
    "market matrix member memory message method metric mirror mobile model module monitor network node number object option order output package "
    "page parser partner payment person plugin pointer policy portal printer process product profile project provider proxy query queue reader "
    "record region release remote render report request resource result router runner sample schema screen search sector server service session "
    "setting shadow signal source space stage stream string style summer system table target task template theme thread ticket timer tracker "
    "transfer update upload user vector vendor version video view volume walker window winter worker writer"
).split()

SECRET_NAMES = (
    "token api_key apikey secret password passwd pwd auth_token access_token client_secret private_key secret_key aws_secret_access_key "
    "aws_access_key_id db_password github_token GITHUB_TOKEN API_KEY AWS_SECRET_ACCESS_KEY AWS_ACCESS_KEY_ID SECRET_KEY DB_PASSWORD accessKey "
    "apiToken clientSecret authToken bearer_token encryption_key signing_key slack_token stripe_key refresh_token credential credentials "
    "MYSQL_ROOT_PASSWORD NPM_TOKEN smtp_password"
).split()

PLAIN_NAMES = (
    "commit sha sha256 md5 checksum etag digest integrity revision build uuid id request_id trace_id session file path url image icon logo hash "
    "version name title label key_name keyword tokenizer token_count secretary author authority description locale fingerprint cache_key "
    "primary_key foreign_key partition_key color font module package checksum_md5 GIT_COMMIT BUILD_ID IMAGE_DIGEST href src data"
).split()


class Line(NamedTuple):
    text: str
    start: int  # of the marked string
    end: int
    path: str
    label: int
    form: str


class Maker:
    def __init__(self, seed: int):
        self.chance = random.Random(seed)

    def pick(self, chars: str, least: int, most: int | None = None) -> str:
        return "".join(self.chance.choices(chars, k=least if most is None else self.chance.randint(least, most)))

    def word(self) -> str:
        return self.chance.choice(WORDS)

    def encoded(self, least: int, most: int) -> str:
        return base64.b64encode(self.chance.randbytes(self.chance.randint(least, most))).decode()

    def password(self) -> str:
        word = self.chance.choice((self.word(), self.word().title(), self.word() + self.word().title()))
        for a, b in self.chance.sample([("a", "4"), ("e", "3"), ("o", "0"), ("s", "$"), ("i", "1"), ("t", "7")], 2):
            word = word.replace(a, b, 1)
        return self.chance.choice((word + self.pick(_DIGITS, 2, 4) + self.chance.choice("!#%*_-?"), self.pick(_ALNUM + "!#%*^-_", 8, 20), word + self.chance.choice("!-_.") + self.pick(_ALNUM, 4, 8)))

    def secrets(self) -> dict[str, Callable[[], str]]:
        chance, pick = self.chance, self.pick
        return {
            "cloud id": lambda: chance.choice(("AKIA", "ASIA")) + pick(_UPPER + _DIGITS, 16),
            "forge": lambda: chance.choice(("ghp_", "gho_", "ghs_")) + pick(_ALNUM, 36),
            "payment": lambda: chance.choice(("sk_live_", "rk_live_", "sk_test_")) + pick(_ALNUM, 24, 32),
            "chat": lambda: f"xox{chance.choice('bp')}-{pick(_DIGITS, 11)}-{pick(_DIGITS, 11)}-{pick(_ALNUM, 24)}",
            "maps": lambda: "AIza" + pick(_ALNUM + "_-", 35),
            "hex": lambda: pick(_HEX, chance.choice((32, 40, 40, 48, 64))),
            "base64": lambda: self.encoded(18, 48),
            "random": lambda: pick(_ALNUM + "_-", 20, 48),
            "cloud secret": lambda: pick(_ALNUM + "+/", 40),
            "jwt": lambda: "eyJ" + pick(_ALNUM, 17, 33) + ".eyJ" + pick(_ALNUM + "_-", 30, 80) + "." + pick(_ALNUM + "_-", 43),
            "password": self.password,
        }

    def others(self) -> dict[str, Callable[[], str]]:
        chance, pick, word = self.chance, self.pick, self.word
        return {
            "digest": lambda: pick(_HEX, chance.choice((32, 40, 64))),
            "uuid": lambda: "-".join(pick(_HEX, k) for k in (8, 4, 4, 4, 12)),
            "integrity": lambda: chance.choice(("sha256-", "sha512-", "sha1-")) + self.encoded(32, 64),
            "picture": lambda: self.encoded(60, 120),
            "path": lambda: "/".join([word() for _ in range(chance.randint(3, 5))]) + chance.choice((".py", ".txt", ".html", "", "/")),
            "address": lambda: f"www.{word()}{word()}.{chance.choice(('com', 'org', 'net'))}/{word()}/{word()}-{pick(_DIGITS, 1, 4)}",
            "mail": lambda: f"{word()}.{word()}{pick(_DIGITS, 0, 3)}.example.{chance.choice(('com', 'org', 'net'))}",
            "name": lambda: chance.choice(("_", "-", ".")).join(word() for _ in range(chance.randint(3, 6))),
            "camel": lambda: word() + "".join(word().title() for _ in range(chance.randint(2, 5))),
            "words": lambda: "".join(word() for _ in range(chance.randint(2, 6))),
            "capitals": lambda: "_".join(word().upper() for _ in range(chance.randint(2, 5))),
            "number": lambda: pick(_DIGITS, 12, 24),
            "time": lambda: f"20{pick(_DIGITS, 2)}-0{pick('123456789', 1)}-1{pick(_DIGITS, 1)}T1{pick(_DIGITS, 1)}:{pick('012345', 1)}{pick(_DIGITS, 1)}",
            "serial": lambda: chance.choice(("-", "")).join(pick(_UPPER + _DIGITS, chance.choice((4, 5))) for _ in range(chance.randint(3, 5))),
            "phone": lambda: "-".join(pick(_DIGITS, k) for k in (3, 3, 4)) + "-" + pick(_DIGITS, 2),
            "rule": lambda: chance.choice("-=._/+") * chance.randint(12, 70),
            "placeholder": lambda: chance.choice(("your_api_key_here", "changeme", "xxxxxxxxxxxxxxxx", "REPLACE_ME_PLEASE", "${SECRET_TOKEN}", "<your-token-here>", "example_password", "insert-token-here", "process.env.API_KEY", "os.environ.get", "placeholder")),
            "release": lambda: f"{word()}-{word()}-{pick(_DIGITS, 1)}.{pick(_DIGITS, 1, 2)}.{pick(_DIGITS, 1)}-{chance.choice(('linux', 'beta', 'rc'))}{pick(_DIGITS, 1, 2)}",
        }

    def path(self) -> str:
        chance, word = self.chance, self.word
        return f"{chance.choice(('', '', 'src/', 'lib/', 'docs/', 'tests/', 'conf/'))}{word()}/{word()}.{chance.choice(('py', 'js', 'md', 'txt', 'env', 'yml', 'json', 'cfg', 'lock'))}"

    def around(self) -> str:
        """Known words, or made-up ones of any language."""
        if self.chance.random() < 0.5:
            return " ".join("".join(self.chance.choice("bdfklmnprstvzéñ") + self.chance.choice("aeiouêü") for _ in range(self.chance.randint(1, 4))) for _ in range(self.chance.randint(0, 7)))
        return " ".join(self.word() for _ in range(self.chance.randint(0, 5)))

    def settings(self, name: str, value: str) -> dict[str, tuple[str, str]]:
        """What stands before and after a value in each setting."""
        chance, word = self.chance, self.word
        quote = chance.choice("\"'")
        user, host = word(), f"{word()}.example.com"
        return {
            "code": (f"{name} = {quote}", f"{quote}{chance.choice((';', '', ' # ' + word()))}"),
            "tight": (f"{name}=", chance.choice(("", " ", "\n", f" {word()}"))),
            "export": (f"export {name.upper()}=", "\n"),
            "quoted export": (f"{name.upper()}={quote}", f"{quote}\n"),
            "yaml": (f"{name}: ", "\n"),
            "json": (f'{{"{word()}": 1, "{name}": "', '"}'),
            "attribute": (f'<{word()} {name}="', '"/>'),
            "flag": (f"{word()} --{name.replace('_', '-')} ", f" {word()}"),
            "query": (f"https://{host}/{word()}?{word()}={chance.randint(1, 9)}&{name}=", chance.choice(("", " ", f"&{word()}=2"))),
            "prose": (f"the {name.replace('_', ' ')} is ", chance.choice((".", ",", f" {word()}"))),
            "header": (f"curl -H {quote}Authorization: Bearer ", f"{quote} https://{host}") if name in SECRET_NAMES else (f"curl -H {quote}If-None-Match: ", f"{quote} https://{host}"),
            "connection": (f"{chance.choice(('postgres', 'mysql', 'https', 'redis', 'amqp'))}://{user}:", f"@{host}/{word()}") if name in SECRET_NAMES else (f"https://{host}/{word()}/", f"/{word()}"),
        }

    def line(self, secret: bool, form: str | None = None, setting: str | None = None) -> Line:
        made = self.secrets() if secret else self.others()
        form = form or self.chance.choice(list(made))
        name = self.chance.choice(SECRET_NAMES if secret or form == "placeholder" else PLAIN_NAMES)
        value = made[form]()
        settings = self.settings(name, value)
        if setting is None:
            fits = [s for s in settings if (form != "password" or s not in ("prose", "yaml", "flag", "query", "header")) and (s != "connection" or form in ("password", "random", "hex") or not secret)]
            told = form in ("cloud id", "forge", "payment", "chat", "maps", "jwt") if secret else form not in ("digest", "placeholder")
            if told and self.chance.random() < 0.4:  # nothing beside it says what it is
                settings, fits = {"bare": ("", "")}, ["bare"]
            setting = self.chance.choice(fits)
        before, after = settings[setting]
        head = f"{self.around()} " + before
        return Line(head + value + after + f" {self.around()}", len(head), len(head) + len(value), self.path(), int(secret), f"{form}, {setting}")


def labelled_lines(n: int = 12_000, seed: int = 11) -> list[Line]:
    """`n` lines, every other with a secret."""
    maker = Maker(seed)
    return [maker.line(bool(i % 2)) for i in range(n)]
