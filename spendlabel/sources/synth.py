"""Synthetic labelled expenses.

One synthetic row per input id (e.g. the keys of a large table), so generation is
spread over the id table's partitions and is reproducible at any partitioning:
every random choice is a 32-bit draw from ``md5(seed:id:salt)``. Values differ from
a Python RNG run; the shapes (categories, vendors, description parts, suffix and
spacing rates, date window, amount ranges) are the source generator's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import title_words

# Category list, vendors and description bases per category, location
# and modifier words, and amount ranges, as in the source generator.
CATEGORIES = [
    "Groceries", "Coffee", "Utilities", "Rent", "Internet", "Phone",
    "Office Supplies", "Dining", "Transportation", "Fuel", "Pharmacy",
    "Entertainment", "Fitness", "Insurance", "Travel", "Electronics",
    "Clothing", "Household", "Parking", "Education",
]
VENDORS = {
    "Groceries": ["Metro", "Loblaws", "No Frills", "Walmart", "Whole Foods", "FreshCo", "Food Basics", "Farm Boy"],
    "Coffee": ["Starbucks", "Tim Hortons", "Second Cup", "Bridgehead", "Balzac's", "Coffee Culture"],
    "Utilities": ["Toronto Hydro", "London Hydro", "Enbridge Gas", "Alectra Utilities", "Hydro One"],
    "Rent": ["Middlesex Property Mgmt", "Campus Rentals", "GreenLeaf Properties", "Dream Properties", "Woodland Apartments"],
    "Internet": ["Rogers", "Bell", "TekSavvy", "Start.ca", "Virgin Plus", "Fido Home"],
    "Phone": ["Rogers Wireless", "Bell Mobility", "Freedom Mobile", "Koodo Mobile", "Telus Mobility"],
    "Office Supplies": ["Staples", "Amazon", "Grand & Toy", "Walmart", "Dollarama"],
    "Dining": ["Chipotle", "McDonalds", "Subway", "Thai Express", "Kinka Izakaya", "Freshii", "A&W", "KFC"],
    "Transportation": ["Uber", "Lyft", "UP Express", "GO Transit", "London Transit", "VIA Rail"],
    "Fuel": ["Esso", "Shell", "Petro-Canada", "Circle K", "Costco Gas"],
    "Pharmacy": ["Shoppers Drug Mart", "Rexall", "Guardian Pharmacy", "Pharma Plus"],
    "Entertainment": ["Cineplex", "Steam", "Spotify", "Apple Services", "Netflix", "PlayStation Store"],
    "Fitness": ["GoodLife Fitness", "Planet Fitness", "YMCA", "LA Fitness", "Anytime Fitness"],
    "Insurance": ["Desjardins Insurance", "TD Insurance", "RBC Insurance", "Intact Insurance"],
    "Travel": ["Air Canada", "Porter Airlines", "VIA Rail", "Expedia", "Flair Airlines", "WestJet"],
    "Electronics": ["Best Buy", "Canada Computers", "The Source", "Apple Store", "Memory Express"],
    "Clothing": ["Uniqlo", "H&M", "Zara", "Winners", "Gap", "Old Navy"],
    "Household": ["IKEA", "Canadian Tire", "Home Depot", "Home Hardware", "Bed Bath & Beyond"],
    "Parking": ["Honkmobile", "City of London Parking", "Green P Parking", "Indigo Parking"],
    "Education": ["Western Bookstore", "Coursera", "Udemy", "edX", "LinkedIn Learning"],
}
DESCRIPTIONS = {
    "Groceries": ["Weekly grocery run", "Fresh produce + pantry items", "Snacks and staples", "Milk, eggs, bread", "Grocery top-up"],
    "Coffee": ["Latte and pastry", "Iced coffee", "Cold brew", "Americano", "Cappuccino", "Mocha"],
    "Utilities": ["Monthly utility bill", "Electricity usage", "Gas service charge", "Electric bill for apt"],
    "Rent": ["Monthly rent payment", "Rent for unit 3B", "Apartment rent"],
    "Internet": ["Monthly internet bill", "Internet plan charge", "Modem rental fee"],
    "Phone": ["Mobile plan payment", "Data overage fee", "Device financing"],
    "Office Supplies": ["Pens and notebooks", "Printer paper (500ct)", "Desk organizer", "Highlighters + sticky notes"],
    "Dining": ["Lunch combo", "Dinner with friends", "Takeout order", "Meal deal", "Student discount meal"],
    "Transportation": ["Ride to campus", "Airport ride", "Commute to work", "Bus pass reload"],
    "Fuel": ["Gas fill-up", "Fuel top-up", "Premium gas purchase"],
    "Pharmacy": ["Vitamins and essentials", "OTC medicine", "Personal care items"],
    "Entertainment": ["Movie tickets", "Game purchase", "Subscription renewal", "Streaming plan"],
    "Fitness": ["Gym membership", "Drop-in class", "Monthly dues"],
    "Insurance": ["Monthly premium", "Policy payment", "Auto insurance"],
    "Travel": ["Flight booking", "Train ticket", "Hotel deposit", "Baggage fee"],
    "Electronics": ["USB-C cable", "Headphones", "Laptop accessory", "Phone case"],
    "Clothing": ["T-shirt and jeans", "Seasonal jacket", "Athleisure", "Socks 3-pack"],
    "Household": ["Cleaning supplies", "Home essentials", "Kitchenware", "Light bulbs"],
    "Parking": ["Parking session", "Evening parking", "All-day parking"],
    "Education": ["Textbook", "Course enrollment", "Exam fee", "Cert prep"],
}
LOCATIONS = ["London ON", "Downtown", "Campus", "Masonville", "Online", "Store #214", "Richmond St"]
MODIFIERS = ["promo", "student", "receipt", "order", "invoice", "ref", "txn", "branch"]
AMOUNT_RANGES = {
    "Rent": (700, 1900),
    "Utilities": (12, 220), "Internet": (12, 220), "Phone": (12, 220),
    "Insurance": (12, 220), "Fitness": (12, 220), "Education": (12, 220),
    "Travel": (60, 900),
    "Electronics": (10, 500), "Clothing": (10, 500), "Household": (10, 500),
}
DEFAULT_RANGE = (3, 140)
VENDOR_SUFFIX_RATE, LOCATION_RATE, MODIFIER_RATE = 0.35, 0.5, 0.4
DOUBLE_SPACE_RATE, LOWER_RATE, TITLE_RATE = 0.25, 0.15, 0.15
DAYS_BACK = 270


def _lits(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def draw(seed: int, id_col: str, salt: str) -> Column:
    """Uniform [0, 1) from 32 bits of md5(seed:id:salt)."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"), F.lit(f":{salt}")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def _pick(arr: Column, n: Column, u: Column) -> Column:
    return F.element_at(arr, (F.floor(u * n) + 1).cast("int"))


def double_first_spaces(txt: Column, k: Column) -> Column:
    """Replace the first ``k`` single spaces by two spaces."""
    parts = F.split(txt, " ")
    n = F.size(parts)
    kk = F.least(k, n - 1)
    head = F.array_join(F.slice(parts, 1, kk + 1), "  ")
    tail = F.array_join(F.slice(parts, kk + 2, F.greatest(n - kk - 1, F.lit(1))), " ")
    return F.when(n > kk + 1, F.concat(head, F.lit(" "), tail)).otherwise(head)


def synthesize_expenses(ids: DataFrame, id_col: str, seed: int = 303, as_of: str = "2025-10-10",
                        balanced: bool = False) -> DataFrame:
    """(id, vendor, description, category, date, amount) for every id. ``balanced`` deals the
    categories in turn over the ids in hash order: n ids per category when there are n times
    as many ids as categories (ids are numbered without a single-task window)."""
    u = lambda salt: draw(seed, id_col, salt)
    k = len(CATEGORIES)
    if balanced:
        from ..operators.maintain import assign_positions
        h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"), F.lit(":deal")))
        ids = assign_positions(ids, h, [id_col])
        ci = ((F.col("pos") - 1) % k).cast("int") + 1
    else:
        ci = F.floor(u("cat") * k).cast("int") + 1
    cat = F.element_at(_lits(CATEGORIES), ci)
    vend_lists = F.array(*[_lits(VENDORS[c]) for c in CATEGORIES])
    desc_lists = F.array(*[_lits(DESCRIPTIONS[c]) for c in CATEGORIES])
    vl = F.element_at(vend_lists, ci)
    dl = F.element_at(desc_lists, ci)
    vendor = _pick(vl, F.size(vl), u("vendor"))
    vendor = F.when(u("suffix") < VENDOR_SUFFIX_RATE,
                    F.concat(vendor, F.lit(" #"), (F.floor(u("suffix_n") * 800) + 100).cast("string"))
                    ).otherwise(vendor)
    base = _pick(dl, F.size(dl), u("desc"))
    loc = F.when(u("loc") < LOCATION_RATE, F.concat(F.lit(" "), _pick(_lits(LOCATIONS), F.lit(len(LOCATIONS)), u("loc_w")))
                 ).otherwise(F.lit(""))
    mod = F.when(u("mod") < MODIFIER_RATE,
                 F.concat(F.lit(" "), _pick(_lits(MODIFIERS), F.lit(len(MODIFIERS)), u("mod_w")), F.lit(" #"),
                          (F.floor(u("mod_n") * 9000) + 1000).cast("string"))).otherwise(F.lit(""))
    txt = F.concat(base, loc, mod)
    txt = F.when(u("dbl") < DOUBLE_SPACE_RATE,
                 double_first_spaces(txt, (F.floor(u("dbl_k") * 3) + 1).cast("int"))).otherwise(txt)
    r = u("case")
    txt = (F.when(r < LOWER_RATE, F.lower(txt))
           .when(r < LOWER_RATE + TITLE_RATE, title_words(F.lower(txt))).otherwise(txt))
    lo = F.element_at(_lits([AMOUNT_RANGES.get(c, DEFAULT_RANGE)[0] for c in CATEGORIES]), ci)
    hi = F.element_at(_lits([AMOUNT_RANGES.get(c, DEFAULT_RANGE)[1] for c in CATEGORIES]), ci)
    cents = lo * 100 + F.floor(u("amount") * (hi - lo) * 100)
    amount = (cents.cast("decimal(14,0)") / 100).cast("decimal(12,2)")
    date = F.date_sub(F.lit(as_of).cast("date"), F.floor(u("date") * (DAYS_BACK + 1)).cast("int"))
    return ids.select(F.col(id_col).alias("id"), vendor.alias("vendor"), txt.alias("description"),
                      cat.alias("category"), date.alias("date"), amount.alias("amount"))
