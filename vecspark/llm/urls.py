"""URL filters: host and path rules, and gradient-boosted trees on lexical features for URLs without a rule.

Everything is DataFrame expressions. The trees are trained by spark.ml on labelled URLs and then written as CASE
expressions over feature columns, so that scoring is generated code without any function call per row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALPHABET = _LOWER + "0123456789-."

# Labelled URLs, invented for training: 0 is a page to keep, 1 one to drop.
CLEAN = """
https://www.riverside-library.org/catalogue/authors
https://blog.marten.dev/2021/notes-on-parsing
https://docs.quartzdb.io/guide/install.html
http://museum.harborcity.org/exhibits/glass
https://en.openalmanac.net/wiki/Lichen
https://news.dailycourier.com/science/article/482
https://www.bakerstreetbread.co.uk/recipes/rye
https://forum.woodturners.net/t/bowl-gouges/118
https://data.statbureau.gov/tables/population
http://www.physics.northvale.edu/courses/optics
https://shop.paperworks.com/pens/fountain
https://m.weatherwatch.net/de/berlin
https://blog.tidepool.example.org/fr/12
https://kitchen.example.com/es/soups/7.html
https://garden.example.net/en/roses?page=2
https://www.orchard.example.org/de/101/
http://letters.example.com/en/88#top
https://maps.trailfinder.org/routes/alps
https://support.lumenware.com/articles/reset
https://www.choirmusic.org/scores/tallis
https://journal.geology.ac.uk/volume/9/issue/2
https://town.fairbrook.gov/council/minutes
https://code.smallforge.io/projects/lexer
https://podcast.stonebridge.fm/episodes/31
https://www.astronomers.net/fr/galerie/m31
http://chess.example.org/en/openings/ruy?page=3
https://birds.example.net/es/atlas/43.html
https://m.trains.example.com/de/fahrplan
https://notes.example.com/en/561?utm_source=feed
https://www.paintings.example.net/fr/19?page=2&ref=x
https://history.example.org/en/rome/3
https://travel.example.com/es/lisboa/
https://dictionary.lexica.org/word/heron
https://www.kiteclub.net/events
https://research.fieldlab.edu/papers/soil
https://www.cityopera.org/season/program
https://radio.waveform.fm/live
https://wiki.sailors.net/knots/bowline
https://www.townmarket.co.uk/stalls/cheese
https://math.problems.org/week/14
https://www.the-valley-herald.com/2021/03/14/council-votes-on-new-bridge
https://old-maps.example.org/en/sheet-12
https://data-tools.lumenware.com/docs/getting-started/install-on-linux
https://www.north-shore-school.edu/news/open-day-2023
http://city-archive.fairbrook.gov/records/1887/box-14/folder-3
https://git.smallforge.io/team-9/lexer/issues/1042
https://www.sea-birds.co.uk/species/arctic-tern
https://cook-book.example.com/fr/tarte-aux-pommes
https://mail-list.quartzdb.io/archive/2019-07/msg00124.html
https://www.k12-science.org/lessons/grade-5/water-cycle
https://open-journal.ac.uk/article/10.5555/8842-19
https://photos.harborcity.org/album/4417/img_20190704.html
https://www.web3-history.example.net/de/seite-2
https://answers.woodturners.net/questions/48213/which-glue-for-oak
https://rail-times.example.com/es/linea-4?day=2
https://x7.observatory.edu/catalog/ngc-7293
http://well-being.clinic.org/advice/sleep
https://news.radio4you.fm/show/2022-11-05
https://books.paperworks.com/isbn/9780000001234
https://archive.tidepool.example.org/en/2004/05/06/7
""".split()
DROP = """
http://cheap-watches-outlet.biz/buy/now.php?id=88321&ref=77&aff=12&sid=9a81
https://www.best-casino-bonus.info/play?code=WIN500&aff=99182&click=8812931
http://free-movie-downloads.xyz/get/8812/99123/file.exe?key=a8f8e91c
http://198-51-100-23.host-pool.top/x/1/2/3/4/5/6/7
https://fast-loans-online.click/apply?amount=5000&term=1&src=mail&uid=19283746
http://replica-bags-discount.example.com/en/12
https://www.miracle-diet-tea.example.net/fr/88
http://hot-singles-nearby.top/join/991823/5512?x=1&y=2&z=3
https://seo-links-store.example.org/de/5?utm_source=feed
http://buy-followers-fast.biz/order.php?pkg=7&pay=btc
https://win-free-phone.example.com/es/301/
http://www.lottery-winner-claim.info/id/77123981/verify?tok=9f81bc22
http://essay-writers-cheap.example.org/en/44.html
https://crypto-double-now.xyz/send?addr=1f8a7c9912bb&n=0001827364
http://link-farm-9921.top/a/b/c/d/e/f
https://www.pharma-no-prescription.example.net/en/210
http://discount-meds-4u.biz/cart?item=771&qty=30&coupon=SAVE90
https://click-track-8812.xyz/r?u=aHR0cDovL3g&k=11827&m=2&c=77
http://account-verify-login.top/secure/update/992817263
https://adult-cams-live.click/room/818273?aff=1192
http://casino-slots.example.com/de/17
https://payday-cash.example.org/fr/9?page=2&ref=x
http://www.cheap-tickets-4u.example.net/en/633#top
https://weight-loss-pills.example.com/en/75
http://get-rich-today.info/step/1/2/3?ref=88271
https://mirror-7781-warez.xyz/dl/77123/setup.exe
http://xn--fake-bank-72a.top/login?session=8817263549
https://betting-odds.example.net/es/402/
http://promo-code-hub.biz/redeem?c=9912&d=8813&e=7714
https://www.fake-reviews.example.org/en/27.html
http://ringtone-free.click/dl?id=1827364&src=pop
https://forex-robot-profit.top/signup?plan=vip&uid=0091827
http://spam-host-22.example.com/fr/66
https://clone-shop.example.org/es/140
http://traffic-exchange-net.xyz/hit/9918/2231/0017
https://www.auto-blog-posts.example.net/de/350
http://mega-sale-outlet.biz/p/00192837465?x=1
https://surf-earn-coins.click/go/77?u=8812&t=9913
http://gold-dealer-cheap.example.com/en/19#top
https://toolbar-update.top/install/latest/setup.exe?v=991827
http://xkqzwv.top/a8f81c9d/77e1b2
http://freegems4u.xyz/claim?user=1&code=77aa91
https://luckyspin.click/win/now
http://hotdealz.biz/cart.php?id=991&sid=aa81f&aff=3
https://cashnow.info/apply?ref=mail&uid=8837261
http://q8w7e6r5.xyz/r/991827/118273
https://bestpills.click/buy?item=blue&qty=90
http://mp3grab.top/dl/song.exe
https://earnfast.biz/join/8817/ref/2291
http://verifyaccount.info/update?session=a81f&token=99b1
https://casinoroyal.xyz/bonus?code=FREE100&aff=77
http://datemenow.click/profile/77281?src=pop
https://loanz.top/quick/7/1/2/3
http://k9x2m4.info/go.php?u=8812&k=aaf1
https://watchfree.biz/movie/99182/play?pid=7
http://cheapseo.xyz/links/771
https://spinbet.top/odds?live=1&m=88&t=991
http://giftcardz.click/get?c=50&d=1a2b3c
https://downloadz.info/setup.exe?v=7
http://trkclk.xyz/c/8a81/f91c/22?z=1
""".split()

#: Trees and their depth, and URLs of a learning task.
TREES, DEPTH, TASK_URLS = 20, 3, 20_000
#: From this probability on, a URL without a rule is blocked.
THRESHOLD = 0.5


@dataclass(frozen=True)
class Rule:
    """Holds for host and its subdomains where the path starts with path; written as host and path together."""

    allow: bool
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ://, up to /, ?, # or the end, A-Z lower-cased; empty for a null or one without ://."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host, up to ?, # or the end; empty for a null or one without ://."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits, or null; of equally long ones the longer host's, then the
    first in order of text."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host), [-ord(c) for c in r.text])):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        text = F.when(fits, F.lit(r.text)).otherwise(text)
        verdict = F.when(fits, F.lit("allow" if r.allow else "block")).otherwise(verdict)
    return text, verdict


def _count(text: Column, char: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))).cast("double")


def features(df: DataFrame, host: str = "host", path: str = "path", url: str = "url") -> tuple[DataFrame, list[str]]:
    """df with lexical features appended, and their names: lengths, depth, labels, hyphens, digit ratios, the entropy of
    the host's characters, parameters, and the length of the last label. suffix is that label."""
    h, p, u = F.col(host), F.col(path), F.coalesce(F.col(url), F.lit(""))
    size = F.greatest(F.length(h), F.lit(1)).cast("double")
    digits = lambda c: F.length(F.regexp_replace(c, "[^0-9]", "")).cast("double")
    # each character's -p log2 p, summed as log2 n - sum(c log2 c) / n
    plain = F.translate(h, "".join(chr(c) for c in range(33, 127) if chr(c) not in _ALPHABET), "")
    terms = [F.when(n > 0, n * F.log2(n)).otherwise(0.0) for n in (_count(plain, c) for c in _ALPHABET)]
    entropy = F.log2(F.greatest(F.length(plain), F.lit(1)).cast("double")) - sum(terms[1:], terms[0]) / F.greatest(F.length(plain), F.lit(1))
    own = {
        "f_length": F.length(u).cast("double"), "f_host_length": F.length(h).cast("double"), "f_depth": _count(p, "/"), "f_labels": _count(h, ".") + 1, "f_hyphens": _count(h, "-"),
        "f_digit_ratio": digits(u) / F.greatest(F.length(u), F.lit(1)), "f_host_digits": digits(h) / size, "f_entropy": entropy, "f_params": _count(u, "?") + _count(u, "&"), "f_suffix_length": F.length(F.substring_index(h, ".", -1)).cast("double"),
    }
    return df.withColumns(own | {"suffix": F.substring_index(h, ".", -1)}), list(own)


def labelled(spark: SparkSession) -> DataFrame:
    """url and label of CLEAN and DROP."""
    rows = ", ".join(f"('{u}', {label})" for label, urls in ((0, CLEAN), (1, DROP)) for u in urls)
    return spark.sql(f"SELECT url, CAST(label AS DOUBLE) AS label FROM VALUES {rows} AS t(url, label)")


@dataclass
class Trees:
    """names of the features, trees as nested (feature, threshold, left, right) or leaf values, and their weights;
    suffixes: log-odds of a label 1 by suffix, smoothed. model: what the trees were read from; no query scores with it."""

    names: list[str]
    trees: list
    weights: list[float]
    suffixes: DataFrame
    model: object = None

    def probability(self) -> Column:
        """Of label 1, from the feature columns."""

        def column(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(node)
            k, at, left, right = node
            return F.when(F.col(self.names[k]) <= at, column(left)).otherwise(column(right))

        margin = sum((column(t) * w for t, w in zip(self.trees, self.weights, strict=True)), F.lit(0.0))
        return 1 / (1 + F.exp(-2 * margin))


def with_suffixes(df: DataFrame, suffixes: DataFrame) -> DataFrame:
    """df with f_suffix; 0 for a suffix that isn't known."""
    return df.join(suffixes, "suffix", "left").withColumn("f_suffix", F.coalesce("f_suffix", F.lit(0.0)))


def train(urls: DataFrame, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """From urls (url, label of 0 or 1), any table; one task learns from TASK_URLS of them, about."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows, names = features(urls.select("url", F.col("label").cast("double").alias("label"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")))
    ones = F.sum("label")
    suffixes = rows.groupBy("suffix").agg(F.log((ones + 2) / (F.count("*") - ones + 2)).alias("f_suffix"))
    names = [*names, "f_suffix"]
    data = VectorAssembler(inputCols=names, outputCol="features").transform(with_suffixes(rows, suffixes)).select("features", "label")
    data = data.coalesce(max(1, -(-urls.count() // TASK_URLS)))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, cacheNodeIds=False).fit(data)

    def node(n):
        if n.subtreeDepth() == 0:
            return float(n.prediction())
        split = n.split()
        return (int(split.featureIndex()), float(split.threshold()), node(n.leftChild()), node(n.rightChild()))

    return Trees(names, [node(t._java_obj.rootNode()) for t in model.trees], list(model.treeWeights), suffixes, model)


_known: dict[str, Trees] = {}


def stated(spark: SparkSession) -> Trees:
    """The trees of CLEAN and DROP, learned once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _known:
        _known.clear()
        _known[app] = train(labelled(spark))
    return _known[app]


def judge(pages: DataFrame, rules: list[Rule], model: Trees, threshold: float = THRESHOLD, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict and probability of each row of pages: the verdict is the rule's, or else block from
    threshold on. A null or empty url has an empty host and path, no rule but one for them, and the trees' verdict."""
    names = pages.columns
    rows = pages.toDF(*[f"_c{i}" for i in range(len(names))]).select(F.col(f"_c{names.index(key)}").alias(key), F.col(f"_c{names.index(url)}").cast("string").alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    text, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows, _ = features(rows.withColumns({"rule": text, "said": verdict}))
    rows = with_suffixes(rows, model.suffixes).withColumn("probability", model.probability())
    return rows.select(key, "host", "path", "rule", F.coalesce("said", F.when(F.col("probability") >= threshold, "block").otherwise("allow")).alias("verdict"), "probability")
