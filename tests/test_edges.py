"""Golden edge rows: tiny inline inputs for the semantics that decide correctness."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spendlabel.operators import clean as C
from spendlabel.operators import sets as S
from spendlabel.operators import validate as V
from spendlabel.session import scratch_path
from spendlabel.sources import files as IO


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_missing_values_are_dropped_not_nan(spark):
    df = spark.createDataFrame([("Metro", None, "Groceries"), (None, None, "X"), ("A b", "c", None)],
                               "vendor string, description string, category string")
    out = V.drop_empty(C.build_text(df))
    assert rows(out, "text", "category") == [("metro", "Groceries")]


def test_trim_strips_all_edge_whitespace(spark):
    df = spark.createDataFrame([("\t a\t", "\n b \r", " Cat\t")], "vendor string, description string, category string")
    r = C.build_text(df).first()
    assert (r["vendor"], r["description"], r["category"], r["text"]) == ("a", "b", "Cat", "a b")


def test_inner_whitespace_kept_for_row_id_but_collapsed_by_normalize(spark):
    df = spark.createDataFrame([("Farm Boy", "Weekly  grocery run", "Groceries"),
                                ("Farm Boy", "Weekly grocery run", "Groceries")],
                               "vendor string, description string, category string")
    ids = rows(C.with_row_id(C.build_text(df)), "row_id")
    assert ids[0] != ids[1]
    norm = rows(C.normalize_text(df, ["description"]), "description")
    assert norm == [("weekly grocery run",), ("weekly grocery run",)]


def test_row_id_is_sha256_of_text_and_category(spark):
    import hashlib
    df = spark.createDataFrame([("Metro", "Milk,  Eggs", "Groceries")], "vendor string, description string, category string")
    got = C.with_row_id(C.build_text(df)).first()["row_id"]
    assert got == hashlib.sha256("metro milk,  eggs||Groceries".encode()).hexdigest()


def test_canonical_category_most_frequent_then_alphabetical(spark):
    df = spark.createDataFrame([("Groceries",), ("groceries",), ("groceries",), ("Dining",), ("dining",),
                                ("  ",), (None,)], "category string")
    out = sorted(rows(C.canonicalize_category(df), "category"), key=str)
    assert out == sorted([("groceries",)] * 3 + [("Dining",)] * 2 + [("  ",), (None,)], key=str)


def test_in_batch_duplicates_survive_anti_join(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "row_id string")
    ledger = spark.createDataFrame([("b",), ("b",)], "row_id string")
    assert sorted(rows(S.filter_unseen(df, ledger), "row_id")) == [("a",), ("a",), ("c",)]


@pytest.mark.parametrize("txt,expected", [
    ("2025-08-01", dt.date(2025, 8, 1)), ("1/5/2025", dt.date(2025, 1, 5)),
    ("2025-02-30", None), ("13/5/2025", None), ("x", None), ("n/a", None), (None, None),
])
def test_staging_dates(spark, txt, expected):
    df = spark.createDataFrame([(txt, "1")], "date_txt string, amount_txt string")
    assert C.parse_staging(df).first()["expense_date"] == expected


@pytest.mark.parametrize("txt,expected", [
    ("$1,234.505", Decimal("1234.51")), ("abc", None), ("-5", Decimal("-5.00")),
    ("(12.00)", Decimal("12.00")), ("--1", None), ("1.2.3", None), ("70.53", Decimal("70.53")),
    ("33.0 CAD", Decimal("33.00")),
])
def test_staging_amounts(spark, txt, expected):
    df = spark.createDataFrame([("2025-01-01", txt)], "date_txt string, amount_txt string")
    assert C.parse_staging(df).first()["amount"] == expected


@pytest.mark.parametrize("txt,num,ok", [
    ("1,234.567", 1234.56, True), (" 12 ", 12.0, True), ("0", 0.0, False), ("abc", None, False),
    ("-3", -3.0, False), ("", None, False),
])
def test_form_amount(spark, txt, num, ok):
    df = spark.createDataFrame([(txt, "2025-01-02")], "amount string, date string")
    r = C.coerce_amount(df).first()
    assert (r["amount_num"], r["amount_ok"], r["date_iso"]) == (num, ok, "2025-01-02")


def test_conform_columns_synonyms_bom_and_missing(spark):
    df = spark.createDataFrame([("v", "d", "c")], ["\ufeff Supplier ", "memo", "Label"])
    assert C.conform_columns(df).columns == ["vendor", "description", "category"]
    both = spark.createDataFrame([("v", "d", "x", "c")], ["vendor", "details", "memo", "class"])
    assert C.conform_columns(both).columns == ["vendor", "description", "memo", "category"]
    with pytest.raises(ValueError, match="missing required columns"):
        C.conform_columns(spark.createDataFrame([("v",)], ["vendor"]))


def test_display_category_title_case_with_hyphens(spark):
    df = spark.createDataFrame([("drop-in class",), ("Drop-In Class",), ("  GROCERIES ",), ("",)], "category string")
    assert rows(C.display_category(df, locale_order=False), "category") == [("Drop-In Class",), ("Groceries",)]


def test_validate_form_profile_reasons(spark):
    df = spark.createDataFrame([
        ("Walmart", "purchased snacks", "groceries", "2025-10-14", "20.0"),
        ("ab", "purchased snacks", "groceries", None, "0"),
        ("Walmart", "x", "", "2025-10-14", "1234567890123"),
    ], "vendor string, description string, category string, date string, amount string")
    typed = df.withColumn("d", F.col("date").try_cast("date"))
    valid, rejected = V.validate_expenses(typed, "form", amount_text="amount", date_value="d")
    assert valid.count() == 1
    reasons = sorted(tuple(r["reasons"]) for r in rejected.collect())
    assert reasons == [("amount_too_long", "description_length", "category_length"),
                       ("date_missing", "amount_invalid", "vendor_length")]


def test_suggest_categories_matches_brute_force(spark):
    cats = ["Groceries", "Coffee", "Office Supplies", "Dining", "Fuel", "Gym Fees", "Drop-In Class",
            "Phone", "Internet", "Entertainment", "Electronics", "Rent"]
    qs = ["", "e", "in", "Co", "zz", "ent"]
    got = S.suggest_categories(spark.createDataFrame([(q,) for q in qs], "q string"),
                               spark.createDataFrame([(c,) for c in cats], "category string"))
    got = sorted(rows(got, "q", "rank", "category"))
    order = sorted(cats, key=lambda c: (c.lower(), c))
    want = []
    for q in {q.lower().strip() for q in qs}:
        if not q:
            picked = order[:8]
        else:
            starts = [c for c in order if c.lower().startswith(q)]
            contains = [c for c in order if not c.lower().startswith(q) and q in c.lower()]
            picked = (starts + contains)[:8]
        want += [(q, i + 1, c) for i, c in enumerate(picked)]
    assert got == sorted(want)


def test_suggestions_look_up_rare_grams_and_verify(spark):
    """Queries longer than a gram, names that hold a query's grams but not the query, repeated
    names, nulls, accents and a name of 20,000 characters."""
    cats = ["abcabd", "abcd", "xabcd", "bcdabc", "abcd", "Éclair abcd", "", None, "a", "ab", "q" * 19_990 + "needle end"]
    qs = ["abcd", "abca", "cdab", "éclair", "needle", "qqqq", "abcdabcd", "nothing", "ab", "A", " bcd ", None, ""]
    got = S.suggest_categories(spark.createDataFrame([(q,) for q in qs], "q string"),
                               spark.createDataFrame([(c,) for c in cats], "category string"), limit=3)
    names = sorted({c for c in cats if c}, key=lambda c: c.lower().replace("é", "e"))
    want = set()
    for q in {(q or "").strip().lower() for q in qs} - {""}:
        hits = [c for c in names if c.lower().startswith(q)] + \
               [c for c in names if q in c.lower() and not c.lower().startswith(q)]
        want |= {(q, i + 1, c) for i, c in enumerate(hits[:3])}
    assert {tuple(r) for r in got.select("q", "rank", "category").filter("q <> ''").collect()} == want
    assert got.filter("q = ''").count() == 3


def test_gram_postings_are_linear(spark):
    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(3_000))
    names = spark.createDataFrame([(text,), (None,), ("",)], "category string")
    assert 0 < S.gram_postings(names, "category").count() <= S.GRAM * len(text)


def test_suggestion_chips_order_and_dedupe(spark):
    df = spark.createDataFrame([("Dining ", [("Dining", 0.5), (" ", 0.3), ("Coffee", 0.2)])],
                               "category string, top array<struct<category:string, prob:double>>")
    assert S.suggestion_chips(df).first()["chips"] == ["Dining", "Coffee"]


def test_csv_reader_bom_quotes_newlines(spark):
    p = scratch_path(spark, "csv_edge")
    import os
    local = p.replace("file:", "")
    os.makedirs(local, exist_ok=True)
    with open(f"{local}/a.csv", "w", encoding="utf-8") as f:
        f.write("\ufeffVendor,Description,Category,date,amount\n")
        f.write('Metro,"Milk,  Eggs,  Bread  London On Ref #3434",Groceries,2025-08-16,99.15\n')
        f.write('"Say ""hi""","two\nlines",Dining,,\n')
    df = C.conform_columns(IO.read_labeled_csv(spark, p))
    got = sorted(rows(df, "vendor", "description", "category", "amount"), key=str)
    assert got == sorted([("Metro", "Milk,  Eggs,  Bread  London On Ref #3434", "Groceries", "99.15"),
                          ('Say "hi"', "two\nlines", "Dining", None)], key=str)


def _write(folder, name, text, gz=False):
    import gzip
    import os
    path = f"{folder.replace('file:', '')}/{name}"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with (gzip.open if gz else open)(path, "wt", encoding="utf-8") as f:
        f.write(text)


def test_csv_folders_compressed_files_and_repeated_names(spark):
    p = scratch_path(spark, "csv_tree")
    _write(p, "a.csv.gz", "vendor,description,category\nMetro,milk,Food\n", gz=True)
    _write(p, "day=1/b [x].csv", "category,vendor,Category,\nFuel,Shell,second,last\n")
    _write(p, "day=1/deep er/c.csv", "\ufeffcategory,description,vendor\nRent,flat,Home\n")
    _write(p, "_skipped.csv", "x\n1\n")
    _write(p, "empty.csv", "")
    df = IO.read_labeled_csv(spark, p)
    assert set(df.columns) == {"vendor", "description", "category", "Category_2", "_c3"}
    assert sorted(rows(df, "vendor", "description", "category", "Category_2", "_c3"), key=str) == sorted(
        [("Metro", "milk", "Food", None, None), ("Shell", None, "Fuel", "second", "last"), ("Home", "flat", "Rent", None, None)], key=str)
    assert IO.read_feedback(spark, p).count() == 3
    one = IO.read_labeled_csv(spark, f"{p}/a.csv.gz", header=["vendor", "description", "category"])
    assert rows(one, "category") == [("Food",)]


def test_staging_file_as_the_seed_file_is_headed(spark):
    p = scratch_path(spark, "staging")
    _write(p, "seed.csv", "vendor,description,category,date,amount\nFarm Boy,Weekly  run,Groceries,2025-08-01,70.53\n")
    _write(p, "later.csv", "amount_txt,Vendor,category,description,date_txt\n$5,Metro,Food,milk,1/5/2025\n")
    df = IO.read_staging_csv(spark, p)
    assert df.columns == list(IO.STAGING_FIELDS)
    assert sorted(rows(df, *IO.STAGING_FIELDS)) == [("Farm Boy", "Weekly  run", "Groceries", "2025-08-01", "70.53"),
                                                    ("Metro", "milk", "Food", "1/5/2025", "$5")]
    _write(p, "bad.csv", "vendor,category\nx,y\n")
    with pytest.raises(ValueError, match="description, date_txt, amount_txt"):
        IO.read_staging_csv(spark, p)


def test_missing_feedback_log_is_empty(spark):
    df = IO.read_feedback(spark, scratch_path(spark, "nothing-here"))
    assert df.count() == 0 and df.columns == list(IO.FEEDBACK_FIELDS)


def test_merge_feedback_amount_as_number_and_noop_when_empty(spark):
    train = spark.createDataFrame([("2025-10-14", "33", "uber", "pizza", "dining")],
                                  "date string, amount string, vendor string, description string, category string")
    fb = spark.createDataFrame([("2025-10-14", "33.0", "uber", "pizza", "dining", "feedback_api", "t")],
                               ", ".join(f"{c} string" for c in IO.FEEDBACK_FIELDS))
    assert S.merge_feedback(train, fb).count() == 1
    assert S.merge_feedback(train, fb.limit(0)).count() == 1


def test_access_paths_for_user_range_and_labels_of(spark):
    from spendlabel.operators import metrics as MT
    from spendlabel.plans.fixtures import Fixtures
    from tests.conftest import SF_SMALL
    fx = Fixtures(spark, SF_SMALL)
    e, lab = fx.expenses, fx.user_labels
    uid = e.agg(F.min("user_id")).first()[0]
    mine = V.for_user(e, uid)
    assert mine.count() == e.filter(F.col("user_id") == uid).count() > 0
    lo, hi = dt.date(1995, 1, 1), dt.date(1996, 12, 31)
    ranged = MT.user_expenses(e, uid, lo, hi)
    assert all(r["user_id"] == uid and lo <= r["expense_date"] <= hi for r in ranged.collect())
    promo = e.filter(F.col("category").startswith("PROMO")).select("expense_id")
    got = MT.labels_of(lab, promo)
    assert got.count() == promo.count()


def test_softmax_rows_sum_to_one_and_keep_order(spark):
    from spendlabel.operators import model as MD
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([1000.0, 0.0, -1000.0],)], "m array<double>")
    out = [r["p"] for r in MD.softmax_scores(df, "m", "p").collect()]
    for p in out:
        assert abs(sum(p) - 1.0) < 1e-12
    assert out[0][2] > out[0][1] > out[0][0] and out[1][0] == 1.0
