"""Universe dimension: entities, groups, search keywords and news queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Sector -> (ticker, search keyword) pairs.
SECTORS = {
    "Information Technology": [
        ("AAPL", "Apple"), ("MSFT", "Microsoft"), ("NVDA", "Nvidia"), ("AVGO", "Broadcom"),
        ("ORCL", "Oracle"), ("CRM", "Salesforce"), ("AMD", "AMD"), ("CSCO", "Cisco")],
    "Communication Services": [
        ("GOOGL", "Google"), ("META", "Meta"), ("NFLX", "Netflix"), ("TMUS", "T-Mobile"),
        ("DIS", "Disney"), ("CMCSA", "Comcast"), ("VZ", "Verizon"), ("T", "AT&T")],
    "Consumer Discretionary": [
        ("AMZN", "Amazon"), ("TSLA", "Tesla"), ("HD", "Home Depot"), ("MCD", "McDonald's"),
        ("NKE", "Nike"), ("LOW", "Lowe's"), ("SBUX", "Starbucks"), ("BKNG", "Booking.com")],
    "Consumer Staples": [
        ("WMT", "Walmart"), ("PG", "Procter & Gamble"), ("COST", "Costco"), ("KO", "Coca-Cola"),
        ("PEP", "Pepsi"), ("PM", "Philip Morris"), ("MO", "Altria"), ("MDLZ", "Mondelez")],
    "Financials": [
        ("BRK-B", "Berkshire Hathaway"), ("JPM", "JPMorgan"), ("V", "Visa"), ("MA", "Mastercard"),
        ("BAC", "Bank of America"), ("WFC", "Wells Fargo"), ("GS", "Goldman Sachs"),
        ("MS", "Morgan Stanley")],
    "Health Care": [
        ("LLY", "Eli Lilly"), ("UNH", "UnitedHealth"), ("JNJ", "Johnson & Johnson"),
        ("MRK", "Merck"), ("ABBV", "AbbVie"), ("TMO", "Thermo Fisher"), ("ABT", "Abbott"),
        ("PFE", "Pfizer")],
    "Industrials": [
        ("GE", "General Electric"), ("CAT", "Caterpillar"), ("RTX", "Raytheon"),
        ("UNP", "Union Pacific"), ("HON", "Honeywell"), ("BA", "Boeing"), ("UPS", "UPS"),
        ("DE", "John Deere")],
    "Energy": [
        ("XOM", "Exxon"), ("CVX", "Chevron"), ("COP", "ConocoPhillips"), ("SLB", "Schlumberger"),
        ("EOG", "EOG Resources"), ("MPC", "Marathon Petroleum"), ("PSX", "Phillips 66"),
        ("WMB", "Williams Companies")],
    "Materials": [
        ("LIN", "Linde"), ("SHW", "Sherwin-Williams"), ("FCX", "Freeport-McMoRan"),
        ("ECL", "Ecolab"), ("NEM", "Newmont"), ("APD", "Air Products"), ("DOW", "Dow Chemical"),
        ("NUE", "Nucor")],
    "Real Estate": [
        ("PLD", "Prologis"), ("AMT", "American Tower"), ("EQIX", "Equinix"), ("WELL", "Welltower"),
        ("SPG", "Simon Property"), ("PSA", "Public Storage"), ("O", "Realty Income"),
        ("CCI", "Crown Castle")],
    "Utilities": [
        ("NEE", "NextEra Energy"), ("SO", "Southern Company"), ("DUK", "Duke Energy"),
        ("CEG", "Constellation Energy"), ("SRE", "Sempra"), ("AEP", "American Electric Power"),
        ("D", "Dominion Energy"), ("EXC", "Exelon")],
}

# Stricter news phrases for names that are ordinary words.
NEWS_PHRASES = {
    "AAPL": '"Apple Inc"', "AMZN": '"Amazon.com"', "V": '"Visa Inc"',
    "META": '"Meta Platforms"', "GOOGL": '(Alphabet OR "Google") ', "ORCL": '"Oracle Corp"',
    "DIS": '"Walt Disney"', "T": '"AT&T"', "O": '"Realty Income"', "D": '"Dominion Energy"',
    "GE": '"General Electric"', "DOW": '"Dow Inc"', "KO": '"Coca-Cola"',
    "PM": '"Philip Morris"', "MO": '"Altria"', "NKE": '"Nike Inc"',
    "MCD": '"McDonald\'s Corp"', "SO": '"Southern Company"', "CAT": '"Caterpillar Inc"',
    "UNP": '"Union Pacific"', "APD": '"Air Products"', "NEM": '"Newmont"',
    "MS": '"Morgan Stanley"', "GS": '"Goldman Sachs"',
}
FINANCE_CLAUSE = "(stock OR shares OR earnings OR investors OR nasdaq OR nyse)"
LANGUAGE_CLAUSE = "sourcelang:eng"

# Investor-intent search keywords.
INVESTOR_KEYWORDS = {
    "WMT": "Walmart stock", "COST": "Costco stock", "MCD": "McDonalds stock",
    "HD": "Home Depot stock", "SBUX": "Starbucks stock", "NKE": "Nike stock",
    "LOW": "Lowes stock", "BKNG": "Booking Holdings stock", "NFLX": "Netflix stock",
    "ABT": "Abbott stock", "DE": "Deere stock", "AAPL": "Apple stock",
    "DIS": "Disney stock", "T": "AT&T stock", "AMZN": "Amazon stock", "VZ": "Verizon stock",
}

# Keywords flagged as ambiguous before looking at any data.
AMBIGUOUS_KEYWORDS = {
    "AAPL": "fruit", "AMZN": "river / general shopping", "V": "travel document",
    "META": "prefix, and the former Facebook brand", "ORCL": "prophecy",
    "TSLA": "the inventor", "CAT": "the insect", "UPS": "power supplies",
    "MPC": "the race", "DUK": "university", "NKE": "Greek goddess / footwear",
    "DIS": "theme parks and films, not the equity", "GOOGL": "navigational search",
    "LOW": "ordinary adjective", "SO": "ordinary word", "DE": "ordinary syllable",
    "PG": "also 'PG' film rating", "MO": "ordinary abbreviation",
    "T": "single letter", "D": "single letter", "O": "single letter",
}

# First valid trading day of late listings, and known splits.
STRUCTURAL_STARTS = [("CEG", "2022-01-19")]
KNOWN_SPLITS = [("NVDA", "2024-06-10", 10), ("AMZN", "2022-06-06", 20), ("GOOGL", "2022-07-18", 20)]


def universe_table(spark: SparkSession, sectors: dict | None = None) -> DataFrame:
    """One row per group, its members nested."""
    rows = [(s, [(t, k) for t, k in m]) for s, m in (sectors or SECTORS).items()]
    return spark.createDataFrame(
        rows, "sector string, members array<struct<ticker:string, keyword:string>>")


def mapping_table(spark: SparkSession, mapping: dict[str, str], value: str) -> DataFrame:
    return spark.createDataFrame(list(mapping.items()), f"ticker string, {value} string")


def starts_table(spark: SparkSession, starts=None) -> DataFrame:
    rows = STRUCTURAL_STARTS if starts is None else starts
    return (spark.createDataFrame(rows, "ticker string, first_date string")
            .withColumn("first_date", F.col("first_date").cast("date")))


def splits_table(spark: SparkSession, splits=None) -> DataFrame:
    rows = KNOWN_SPLITS if splits is None else splits
    return (spark.createDataFrame(rows, "ticker string, split_date string, ratio int")
            .withColumn("split_date", F.col("split_date").cast("date")))


def flatten_universe(nested: DataFrame) -> DataFrame:
    """(ticker, keyword, sector) from the nested universe."""
    return (nested.select("sector", F.explode("members").alias("m"))
            .select("m.ticker", "m.keyword", "sector"))


def resolve_news_queries(members: DataFrame, overrides: DataFrame,
                         finance_filter: bool = True) -> DataFrame:
    """Boolean news query per entity: override phrase, else the quoted keyword."""
    phrase = F.coalesce("phrase", F.format_string('"%s"', "keyword"))
    parts: list[Column] = [phrase]
    if finance_filter:
        parts.append(F.lit(FINANCE_CLAUSE))
    parts.append(F.lit(LANGUAGE_CLAUSE))
    return members.join(overrides, "ticker", "left").select(
        "ticker", F.concat_ws(" ", *parts).alias("query"))


def resolve_keywords(members: DataFrame, overrides: DataFrame) -> DataFrame:
    """Search keyword per entity: the disambiguated one, else its own."""
    return members.join(overrides, "ticker", "left").select(
        "ticker", F.coalesce("investor_keyword", "keyword").alias("keyword"))
