"""Facts in prose: half of the cases are traps that must stay null."""

from pyspark.sql import functions as F

from jobsieve.functions.facts import best_pay, extract_facts, money_mentions, written_number
from jobsieve.functions.htmltext import html_to_text
from jobsieve.functions.spans import find_spans

PAY = [
    ("Base salary for the post lies between $98,000 - $127,500 per year.", (98000, 127500, "year", 98000, 127500)),
    ("Compensation band: $83K-$104K", (83000, 104000, "year", 83000, 104000)),
    ("We pay a base salary of $71,500 to $88,250 annually", (71500, 88250, "year", 71500, 88250)),
    ("Expect an hourly rate of $41 - $58 per hour.", (41, 58, "hour", 85280, 120640)),
    ("Hourly pay: $37/hr", (37, None, "hour", 76960, None)),
    ("Salary band 64,000 - 79,000 per year", (64000, 79000, "year", 64000, 79000)),
    ("Yearly compensation comes to USD 112,000 annually.", (112000, None, "year", 112000, None)),
    ("Salary: £43,500 - £51,000 per annum", (43500, 51000, "year", 43500, 51000)),
    ("$92,400/yr - $118,600/yr", (92400, 118600, "year", 92400, 118600)),
    ("$33.50/hr - $47.25/hr", (33.5, 47.25, "hour", 69680, 98280)),
    ("A salary of $6,250 per month", (6250, None, "month", 75000, None)),
    ("Bring a friend and earn a referral bonus of $1,500. The base salary range here is $86,000 - $97,000.",
     (86000, 97000, "year", 86000, 97000)),
    ("Our vans deliver 48,000 parcels to 17 towns.", None),
    ("Investors put $35 million in funding into the firm.", None),
    ("Join our 401(k) and get a 4% match.", None),
    ("You get a $3,250 sign-on bonus.", None),
    ("A reimbursement of up to $275 per month for train tickets.", None),
    ("Equipment budget: $850", None),
    ("The plant turns over $250,000,000 in revenue.", None),
    ("", None),
]
YEARS = [
    ("6+ years of bakery management experience required.", 6), ("4-7 years of hands-on experience.", 4),
    ("Minimum of eight (8) years experience with looms.", 8),
    ("2+ years in fleet dispatch. 6+ years of routing experience.", 6),
    ("You bring at least 3 years experience.", 3), ("Requires 5 yrs experience.", 5),
    ("- 4+ years of independent surveying", 4), ("3-6 years of harbour pilot work", 3),
    ("This family firm has been in business for over 35 years.", None),
    ("We look at people who have moved house in the past 2 years.", None),
    ("A brewery with 60 years of history in town.", None), ("The lease runs for 4 years.", None),
    ("35+ years of experience", None), ("", None),
]
FLAGS = [
    ("You need an active Top Secret clearance.", "needs_clearance", True),
    ("Candidates hold TS/SCI access.", "needs_clearance", True), ("Repair harbour cranes.", "needs_clearance", False),
    ("The yard is unable to sponsor visas.", "sponsorship_unavailable", True),
    ("Applicants must be a US citizen.", "sponsorship_unavailable", True),
    ("Pilots must be a U.S. citizen.", "sponsorship_unavailable", True),
    ("For this post visa sponsorship is available.", "sponsorship_unavailable", False),
    ("The engineer must relocate to Tulsa.", "requires_relocation", True),
    ("We help with relocation assistance.", "requires_relocation", False),
    ("Please note: not a remote position.", "not_remote", True), ("All welders must work on-site.", "not_remote", True),
    ("They cannot sponsored the fair", "sponsorship_unavailable", False),
]
NUMBERS = [
    ("Be ready to travel up to 35% of the month.", "travel_pct", 35), ("Plan for 15% travel.", "travel_pct", 15),
    ("Travel up to 20-45% across the coast.", "travel_pct", 45), ("Travel 160% of the year", "travel_pct", None),
    ("The pension gets a 7% employer match.", "travel_pct", None),
    ("The crew is on-site 4 days per week.", "onsite_days_per_week", 4),
    ("Plan for two days a week in the office.", "onsite_days_per_week", 2),
    ("Sit wherever you like.", "onsite_days_per_week", None),
]


def rows(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, description string")
    return [r for r in sorted(extract_facts(df).collect(), key=lambda r: r.i)]


def test_pay(spark):
    for r, (text, want) in zip(rows(spark, [t for t, _ in PAY]), PAY):
        got = (r.pay_min, r.pay_max, r.pay_period, r.pay_min_annual, r.pay_max_annual)
        assert got == (want or (None, None, "", None, None)), text
        assert bool(r.pay_raw) == bool(want)


def test_pay_text_and_currency(spark):
    r = rows(spark, ["The base salary range is $120,000 - $150,000 per year.", "Salary £70,000 - £85,000 per annum"])
    assert r[0].pay_raw == "$120,000 - $150,000 per year"
    assert r[1].pay_currency == "£"


def test_first_of_equally_good_pay_wins(spark):
    r = rows(spark, ["Salary $90,000 per year. Salary $80,000 per year."])[0]
    assert r.pay_min == 90000


def test_years(spark):
    for r, (text, want) in zip(rows(spark, [t for t, _ in YEARS]), YEARS):
        assert r.yoe_min == want, text


def test_at_most_six_mentions(spark):
    r = rows(spark, ["; ".join(f"{n}+ years of x" for n in range(1, 10))])[0]
    assert r.yoe_min == 9 and len(r.yoe_mentions) == 6


def test_flags_and_numbers(spark):
    cases = FLAGS + NUMBERS
    for r, (text, name, want) in zip(rows(spark, [t for t, *_ in cases]), cases):
        assert r[name] == want, text


def test_snippets(spark):
    r = rows(spark, ["An active Secret clearance is required."])[0]
    assert r.flag_snippets == {"needs_clearance": "An active Secret clearance is required."}


def test_null_text(spark):
    r = rows(spark, [None])[0]
    assert r.pay_min is None and r.needs_clearance is False and r.yoe_mentions == []


def test_ten_km_and_strict_k(spark):
    df = spark.createDataFrame([("salary near 10 km",)], "t string")
    loose, strict = df.select(F.size(money_mentions("t")), F.size(money_mentions("t", strict_k=True))).first()
    assert (loose, strict) == (1, 0)


def test_spans_have_exact_offsets(spark):
    text = "a12b345 é6 78"
    out = spark.createDataFrame([(text,)], "t string").select(find_spans("t", r"\d+").alias("s")).first().s
    assert [(s.start, s.end, s.m) for s in out] == [(1, 3, "12"), (4, 7, "345"), (9, 10, "6"), (11, 13, "78")]
    assert all(text[s.start:s.end] == s.m for s in out)


def test_written_number(spark):
    df = spark.createDataFrame([("Seven",), ("1,200",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(written_number("t")).collect()] == [7, 1200, None, None]


def test_facts_need_no_shuffle_and_no_python(spark):
    df = spark.range(5).select(F.lit("Salary $90,000 per year").alias("description"))
    plan = extract_facts(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert best_pay is not None


def test_html_to_text(spark):
    html = ("<style>x{}</style><p>A &amp; B &#233; &#x1F600; &foo; &nbsp;c</p><!-- no --><ul><li>one<li>two</li></ul>"
            "<script>var t='<p>'</script>end<br/>x")
    got = spark.createDataFrame([(html,), (None,)], "h string").select(html_to_text("h").alias("t")).collect()
    assert got[0].t == "A & B é 😀 &foo; c\n\n- one\n- two\nend\nx"
    assert got[1].t == ""


def test_windows_across_piece_borders(spark):
    for pad in (0, 2030, 2040, 2047, 2048, 4090, 6000):
        text = "é" * pad + " The base salary range is $120,000 - $150,000 per year. Minimum of seven (7) years experience."
        r = rows(spark, [text])[0]
        assert (r.pay_min, r.pay_max, r.pay_raw, r.yoe_min) == (120000, 150000, "$120,000 - $150,000 per year", 7), pad


def test_spans_of_many_matches(spark):
    """Offsets are running sums: any number of matches, and time in proportion to it."""
    import re
    import time

    from jobsieve.functions.spans import find_spans

    texts = [None, "", "no", "1", "é9𝄞 88", *("x 1 yy 22 " * n for n in (1, 2, 3, 4, 5, 8, 9, 100, 10_000))]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", find_spans("t", "[0-9]+").alias("all"), find_spans("t", "[0-9]+", "2", keep="22").alias("kept")).collect()
    for r in got:
        want = None if r.t is None else [(m.start(), m.end(), m.group()) for m in re.finditer("[0-9]+", r.t)]
        assert (r["all"] if r["all"] is None else [tuple(s) for s in r["all"]]) == want
        assert r.t is None or [tuple(s) for s in r.kept] == [w for w in want if "22" in w[2]]
    took = []
    for n in (20_000, 20_000, 160_000):  # the first run compiles
        df = spark.createDataFrame([("a 1 " * n,)], "t string").select(find_spans("t", "[0-9]+").alias("s"))
        start = time.perf_counter()
        assert df.select("s").first().s[-1].end == 4 * n - 1
        took.append(time.perf_counter() - start)
    assert took[2] < 30 * took[1]  # 64 times if every match copied those before it


def test_guarded_pay_patterns_match_what_the_plain_ones_match(spark):
    """Patterns that run at every character of a text turn most of them away after one look."""
    import random

    from jobsieve.functions import facts as X
    from jobsieve.functions.regex import rx

    plain = {
        X.MONEY: rx(r"(?:(" + X.CURRENCY_CODES + r"){S}*)?([$€£₹])?{S}?(\d{1,3}(?:,\d{3})+|\d+(?:\.\d{1,2})?){S}*(k|K)?"),
        X._MONEY_HINT: rx(r"[$€£₹]|\d,\d{3}|\d{S}*[kK]|" + X.CURRENCY_CODES),
        X.NOT_PAY_NEAR: rx(r"revenue|funding|raised|valuation|market cap|budget of|assets under|in sales|grant|award of|deductible"
                           r"|premium of|401{S}*\(?k\)?|copay", True),
        X.PAY_CUE: rx(r"salary|salaries|compensation|pay range|pay rate|base pay|base salary|hourly rate|rate of pay|remuneration"
                      r"|total rewards|total compensation|annual(?:ized)? (?:pay|rate)|per year|per hour|/{S}*yr|/{S}*hr"
                      r"|expected pay|target pay|pay band|wage", True),
    }
    words = ["salary", "Salaries", "compensation", "pay range", "PAY RATE", "pay band", "base pay", "base salary", "hourly rate", "rate of pay", "remuneration", "total rewards",
             "total compensation", "annual pay", "annualized rate", "per year", "per hour", "/ yr", "/hr", "expected pay", "target pay", "wage", "revenue", "Funding", "raised",
             "valuation", "market cap", "budget of", "assets under", "in sales", "grant", "award of", "deductible", "premium of", "401(k", "401 k", "copay",
             "USD", "CAD", "AUD", "EUR 5", "GBP 7", "INR", "SGD", "CHF 1", "NZD", "$", "€", "£ 1", "₹2", "1,000", "12.50", "7k", "8 K", " 9", "\t3", "x", "Y", " ", "-", "(", "/", "pa", "se", "é"]
    rng = random.Random(7)
    texts = [rng.choice(["", " "]).join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(4000)] + words
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = lambda p: F.regexp_extract_all("t", F.lit(p), F.lit(0))
    assert df.where(F.array(*map(found, plain)) != F.array(*map(found, plain.values()))).count() == 0
    assert all(p.replace("(?i)", "").startswith(("(?=", "(?!")) for p in plain)
    # A period is told from its word once, and still the one that ends the match.
    got = spark.createDataFrame([(" per yr. then hour", 5.0), ("/HR", 5.0), (" -", 5000.0), ("", 500.0), ("annually", 1.0), ("manyear", 300.0)], "a string, v double")
    rows = got.select(X.pay_period(F.col("a"), F.col("v")).alias("p")).select("p.*").collect()
    assert [(r.period, r.explicit, r.upto) for r in rows] == [
        ("year", True, 7), ("hour", True, 3), ("year", False, 0), (None, False, 0), ("year", True, 8), (None, False, 0)]
