"""Small sales tables with known results."""

TRUST_COLUMNS = ["order date", "revenue", "category", "region", "price", "quantity"]
TRUST = [
    ("2024-01-01", "100", "Electronics", "North", "10", "10"),
    ("2024-01-02", "120", "Electronics", "North", "12", "10"),
    ("2024-01-03", "90", "Furniture", "South", "9", "10"),
    ("2024-01-04", "500", "Electronics", "South", "50", "10"),
    ("2024-01-05", "110", "Furniture", "North", "11", "10"),
]

REGIONAL_COLUMNS = ["date", "revenue", "category", "region", "price", "quantity"]


def regional():
    """24 days, four lines of business that each grow by a fixed step."""
    lines = [
        ("Enterprise", "North", [2400, 2520, 2640, 2760, 2880, 3000]),
        ("Retail", "South", [1260, 1350, 1440, 1530, 1620, 1710]),
        ("Online", "West", [1760, 1840, 1920, 2000, 2080, 2160]),
        ("Channel", "East", [2100, 2190, 2280, 2370, 2460, 2550]),
    ]
    rows = []
    for day in range(24):
        category, region, amounts = lines[day % 4]
        amount = amounts[day // 4]
        rows.append((f"2024-03-{day + 1:02d}", str(amount), category, region, str(amount // 10), "10"))
    return rows


def watchlist():
    """23 days with one negative amount; the last row comes twice."""
    categories = (
        "Software Software Services Hardware Software Services Hardware Software Services Hardware Software "
        "Software Hardware Software Services Hardware Software Services Hardware Software Services Hardware Software"
    ).split()
    regions = (
        "North South West East North South West East North South West West East North South West East North "
        "South West East North South"
    ).split()
    amounts = [1500] + [1620 + 130 * k for k in range(10)] + [-320] + [2920 + 130 * k for k in range(11)]
    rows = []
    for day, (amount, category, region) in enumerate(zip(amounts, categories, regions), 1):
        quantity = 2 if amount < 0 else 10
        rows.append(
            (f"2024-05-{day:02d}", str(amount), category, region, str(amount // quantity), str(quantity))
        )
    return rows + rows[-1:]
