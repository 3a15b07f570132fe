"""URL filter: rules by host and path, then logistic regression on hashed character n-grams of host and path.

Host and path are cut with DataFrame functions. The longest rule that fits
decides; else the model, trained from the small labelled table below, blocks
from a probability of one half. A null url, or one without ://, has empty host
and path, meets no rule and is allowed. Repeated rows are rows like any other;
an empty table gives an empty one. Urls are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import mix, utf8

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
BITS = 16
ORDERS = (3, 4, 5)
#: Names to block, by kind; a name is a host's label or labels. None of them, and none of the harmless ones, is a host of the test tables.
BLOCKED = {
    "adult": """pornhub xvideos-mirror freeporn xxxcams sexchat-live nudegirls hotmilfs hentaihub escorts-now adultfriend adult-videos adultdating eroticstories camgirls-online
    sexy-singles fetishworld xxx-tube pornstars amateurporn teen-cams nakedpics hookup-tonight sexshop24 stripclub-tv playgirls adult-movies bigboobs-tube sextoys-direct livecams-xxx
    dirtychat nsfw-gallery lesbianporn gaysex-clips adult-webcams sexfinder pornzone adulttoons xxxlinks""",
    "gambling": """casino-royal bestcasino onlinecasino24 megacasino casinobonus vegas-slots slots-heaven slotmachines-free luckyslots pokerstars-bonus pokerhands888 bet365-login betway-promo betnow sportsbetting
    bet-online livebets football-bets bingo-cash roulette-king blackjackpro jackpot-city megajackpot lottery-winner lottowin freespins spin-and-win baccarat88 sportsbook-odds wager-king
    crypto-casino gamble-today casinogames poker-room betting-tips casino-spins winbig-bet highroller-bets""",
    "drugs": """buyviagra viagra-online cialis-discount pills-shop onlinepills dietpills-now weightloss-pills nordx-meds cheapmeds meds-without-prescription xanax-buy tramadol-overnight steroids-market
    canadian-pharmacy-rx generic-pharma-deals pillstore rx-pills-direct sleeping-pills-online potency-pills oxycontin-cheap cheap-viagra cheap-cialis discount-meds hgh-steroids kratom-pills""",
    "spam": """free-money-now getrichfast make-cash-online earn-from-home linkfarm-pro link-farm-network spamlinks seo-backlinks buy-backlinks mass-mailer bulkspam spam-blaster spamzone click-here-win free-iphone-prize
    claim-your-prize giveaway-winner payday-loans-fast instant-cash-loans bitcoin-doubler crypto-giveaway miracle-cure work-from-home-cash cheap-replica-watches replica-handbags fake-followers buylikes
    content-farm article-farm spun-articles doorway-pages spamdirectory free-gift-cards surveys-for-cash""",
    "ads": """adserver ads-server adserving adclick-zone doubleclick popads popunder-network banner-ads adsbanner trackclick click-tracker trackingpixel pixel-track usertracking web-tracker adtrackers adnetwork
    ads-exchange bannerfarm affiliate-tracker clickbank-ads adbeacon telemetry-collect retarget-ads trackads adsyndication sponsor-ads interstitial-ads adtech-pixel tracker-cdn""",
    "malware": """warez-world warezcrack cracked-software keygen-download serialkeys nulledscripts torrent-hub torrentz-proxy piratebay-proxy thepiratebay moviepirate free-apk-mod hacktool-download cheat-engine-hacks
    phish-login secure-login-verify paypal-account-update apple-id-verify bank-login-confirm malware-drop virus-scan-alert fake-antivirus your-pc-is-infected trojan-download exploit-kit botnet-panel
    free-cracks crackz-serials software-keygens password-stealer""",
}
#: Harmless names, among them many that hold letters of the names above.
HARMLESS = """wikipedia wiktionary stackoverflow stackexchange github gitlab sourceforge python kernel debian ubuntu mozilla apache nytimes washingtonpost theguardian bbc reuters apnews lemonde lefigaro
elpais elmundo lavanguardia spiegel zeit faz sueddeutsche tagesschau corriere repubblica nature science sciencedirect springer arxiv jstor plos pubmed nih who unesco europa bundestag senat gouvernement
harvard stanford berkeley mit oxford cambridge sorbonne heidelberg essex.ac.uk sussex.ac.uk middlesex.edu wessex-archaeology scunthorpe penistone clitheroe dickens-museum cockburn-library sextant-sailing
sexton-history assessments classics-department grassland-trust passport-office compass-school embassy masseurs-guild pillsbury pillow-shop pillars-of-history spillway-engineering slotcars slot-car-racing timeslot-booking
spamhaus antispam-research bettyfarms bettys-tearooms betterhomes alphabet-school beta-testing tibet-museum elizabeth-church diabetes-care sherbet-recipes farmersmarket family-farm organic-farm dairy-farms windfarm-survey
pharmacyschool pharmacology-review hospital-pharmacy medschool medieval-history mediterranean-cooking adsorption-lab adscititious roadside-repairs leadership-academy readspeaker headstart-school loads-of-recipes
trackandfield track-cycling railtracks-museum soundtracks-archive pixelart banners-and-flags clickers-for-dogs clicktrack-music winemakers winterthur windows-and-doors darwin-online twin-cities winchester
freedom-library freelance-writers freeman-history freiburg freezer-repair carefree-gardens cashmere-weavers cashew-recipes moneyhistory central-bank cheapside-history cheaptravel-guide camsite-cambridge campsites-france cambrian-news
adulteducation adult-literacy casinotheater-winterthur crackers-recipes nutcracker-ballet hacksaw-tools hackney-council torrential-rain-study torrents-of-catalonia analysis-group analytica-chimica cocktail-history titanic-museum
shitake-mushrooms magna-carta sexual-health-clinic breastcancer-care xxth-century-history poker-faced-portraits bingen-am-rhein bingley-library lottery-funded-heritage rxjs viaggi-in-italia specialist-care socialist-history
news library university museum garden recipes weather history school docs manual forum wiki travel music books gallery archive health city-hall sports-club open-data maths physics community-garden bookshop
local-news long-walks blue-river night-sky teahouse north-wind mountain-hut cinema theatre opera-house orchestra photography kitchen bakery brewery vineyard beekeeping woodworking knitting sewing pottery chess astronomy
geology botany zoology chemistry economics law philosophy linguistics translation dictionary encyclopedia maps trains buses airport harbour bridges castles cathedral parish council parliament elections court police fire-brigade
kindergarten nursery playground toys puzzles games football rugby cricket tennis swimming rowing hiking climbing skiing camping fishing sailing cycling running yoga dentist doctor clinic hospital pharmacy optician veterinary
biblioteca universidad ayuntamiento noticias recetas historia escuela mairie bibliotheque musee ecole cuisine actualites jardin rathaus bibliothek schule nachrichten garten wetter rezepte geschichte verein feuerwehr stadtwerke
data-science machine-learning statistics algorithms compilers databases networks security-research open-source tutorials lecture-notes homework exams scholarships careers jobs housing rentals furniture carpets curtains hardware-store
plumbing electrician insurance accounting tax-office pension savings-bank credit-union farmers-union trade-fair conference workshop festival carnival parade wedding-photos birthday-cakes family-tree genealogy obituaries""".split()
#: Words that make a name one to block, and words that say nothing: these go with harmless names as well.
_STEMS = """adult porn xxx sex nude erotic escort hentai milf webcamgirls naked fetish casino poker slots betting roulette blackjack jackpot bingo gambling lotto spins viagra cialis pills meds dietpills steroids xanax
tramadol spam linkfarm backlinks seospam freemoney quickcash getrich payday prizes giveaway replica ads adserver tracker popup popunder banner clicktrack adtrack warez crack keygen torrent nulled pirate hacks phishing malware serialz""".split()
_PLAIN = "best my the online free get web net top hub zone world 24 shop store site home club center now live pro easy new daily".split()
_SYLLABLES = "ba be bi bo bra cal cen co dan del dor e fa fen gar gil ha hel i jo ka kel la lem lor ma men mi mor na nel no o pa per qui ra rel ro sa sel son ta ter tol u va ver vin wa wil yor za".split()
_HEADS = ("", "www.", "blog.", "m.", "shop.", "news.")
_TAILS = ("com", "org", "net", "info", "co.uk", "de", "fr", "es", "io", "example.com", "example.org")
_PATHS = ("/en/123", "/de/45.html", "/fr/7?page=2", "/es/88/", "/about", "/post/2020/01/title-of-post", "/", "/index.html", "/a/b/c", "/products/list", "")
_BAD_PATHS = "casino/bonus bets/today adult/videos pills/order porn/1 warez/crack.zip viagra/buy xxx/cams poker/freespins ads/click track/pixel.gif keygen/download torrent/movie sex/chat banner/adclick".split()


def labelled() -> list[tuple[str, str, int, str]]:
    """(host, path, whether to block, name): each name above with several heads, tails and paths, made-up names as harmless ones, and paths to block on harmless hosts."""
    rng = np.random.default_rng(20240607)
    made = ["".join(rng.choice(_SYLLABLES, n)) for n in rng.integers(2, 5, 500)]
    simple = [n for n in HARMLESS if "." not in n]

    def joined(names: list[str], many: int) -> list[str]:
        """Each name with some of the plain words ahead or behind, with or without a hyphen."""
        out = []
        for n in names:
            for p in rng.choice(_PLAIN, many, replace=False):
                out.append(str(rng.choice(["", "-"])).join((str(p), n) if rng.random() < 0.5 else (n, str(p))))
        return out

    rows, i = [], 0
    for block, names in ((1, [n for kind in BLOCKED.values() for n in kind.split()]), (0, HARMLESS), (0, made), (1, joined(_STEMS, 6)), (0, joined(simple, 2)), (0, joined(made[:200], 1))):
        for name in names:
            for j in range(2):
                tail = "" if "." in name else "." + _TAILS[(i * 5 + j * 3) % len(_TAILS)]
                rows.append((f"{_HEADS[(i + j) % len(_HEADS)]}{name}{tail}", _PATHS[(i * 3 + j * 4) % len(_PATHS)], block, name))
            i += 1
    for i, path in enumerate(_BAD_PATHS):
        rows += [(f"{HARMLESS[(i * 17 + j * 31) % len(HARMLESS)]}.{_TAILS[j]}", f"/{path}", 1, path) for j in range(4)]
    return rows


def grams(texts: pa.Array, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(cell, text) of each distinct n-gram of each text."""
    data, offsets = utf8(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    b = data.astype(np.uint64)
    cells, owners = [], []
    for k in ORDERS:
        if len(b) < k:
            continue
        key = np.zeros(len(b) - k + 1, np.uint64)
        for j in range(k):
            key = key << np.uint64(8) | b[j : len(b) - k + 1 + j]
        ok = owner[: len(key)] == owner[k - 1 :]
        cells.append((mix(key[ok] + np.uint64((k + salt) << 56)) >> np.uint64(64 - BITS)).astype(np.int64))
        owners.append(owner[: len(key)][ok])
    if not cells:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique((np.concatenate(owners) << BITS) | np.concatenate(cells))
    return both & ((1 << BITS) - 1), both >> BITS


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, url, weight): the n-grams of host and of path have cells of their own, each part of a url has norm one."""
    out = []
    for salt, column in ((0, [f"^{h}^" for h in hosts]), (64, [f"|{p}|" for p in paths])):
        cell, owner = grams(pa.array(column, pa.large_string()), salt)
        out.append((cell, owner, (1 / np.sqrt(np.maximum(np.bincount(owner, minlength=len(column)), 1)))[owner]))
    return tuple(np.concatenate(x) for x in zip(*out))


def train(rows: list[tuple[str, str, int, str]] | None = None, rounds: int = 200, rate: float = 0.15, decay: float = 0.05) -> np.ndarray:
    """Weights of the cells, the last one the bias: Adagrad on the mean log loss of the labelled table, both classes weighing alike."""
    rows = labelled() if rows is None else rows
    cell, owner, x = features([r[0] for r in rows], [r[1] for r in rows])
    y = np.array([r[2] for r in rows], float)
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, square = np.zeros((1 << BITS) + 1), np.full((1 << BITS) + 1, 1e-8)
    for _ in range(rounds):
        d = weight * (y - 1 / (1 + np.exp(-np.bincount(owner, w[cell] * x, len(rows)) - w[-1])))
        g = np.append(np.bincount(cell, d[owner] * x, 1 << BITS), d.sum()) - decay / len(rows) * w
        square += g * g
        w += rate * g / np.sqrt(square)
    return w


def probability(w: np.ndarray, hosts: list[str], paths: list[str]) -> np.ndarray:
    cell, owner, x = features(hosts, paths)
    n = len(hosts)
    p = 1 / (1 + np.exp(-np.bincount(owner, w[cell] * x, n) - w[-1]))
    p[[i for i in range(n) if not hosts[i] and not paths[i]]] = 0.0
    return p


def judge(pages: DataFrame, weights: np.ndarray, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of each page."""
    rest = F.coalesce(F.expr("if(instr(url, '://') > 0, substring(url, instr(url, '://') + 3), '')"), F.lit(""))
    host = F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", rest.alias("rest"))
    cut = cut.select("page_id", host.alias("host"), F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocked = probability(weights, b.column("host").to_pylist(), b.column("path").to_pylist()) >= 0.5
            said = b.column("verdict").to_pylist()
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "host", "path", "rule")), pa.array([s or ("block" if x else "allow") for s, x in zip(said, blocked)], pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return cut.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict")).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
