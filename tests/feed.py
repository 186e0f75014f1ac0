"""A hand-made delivery: order lines with the rows of two foreign sheets and blank lines between."""

import csv
import io

from ledgerlens.sources.contract import RETAIL_CONTRACT

HEADER = [source for source, _, _ in RETAIL_CONTRACT]

BASE = dict(zip(HEADER, (
    "1", "US-2016-1", "11/8/2016", "11/11/2016", "Second Class", "CG-1", "Claire Gute", "Consumer",
    "United States", "Henderson", "Kentucky", "04240", "South", "FUR-1", "Furniture", "Bookcases",
    'Shelf, 36"" wide'.replace('""', '"'), "261.96", "2", "0", "41.9136",
)))


def text(*changes, tail="Person,Region\r\nAnna,West\r\n\r\nReturned,Order ID\r\nYes,US-2016-1\r\n"):
    out = io.StringIO()
    writer = csv.writer(out)
    writer.writerow(HEADER)
    for i, change in enumerate(changes):
        writer.writerow({**BASE, "Row ID": str(i + 1), **change}.values())
    return out.getvalue() + tail


def good_lines():
    """Eight orders over four years, all gates green."""
    lines = []
    for i, year in enumerate((2015, 2015, 2016, 2016, 2017, 2017, 2018, 2018)):
        high = i % 2 == 1
        lines.append(
            {
                "Order ID": f"US-{year}-{i}",
                "Order Date": f"1/{i + 3}/{year}",
                "Ship Date": f"2/{i + 3}/{year}",
                "Region": ("Central", "East", "South", "West")[i % 4],
                "State": ("Texas", "Ohio", "Utah", "Iowa")[i % 4],
                "Segment": ("Consumer", "Corporate", "Home Office")[i % 3],
                "Category": ("Furniture", "Office Supplies", "Technology")[i % 3],
                "Sub-Category": ("Tables", "Paper", "Phones")[i % 3],
                "Sales": "100.5",
                "Discount": "0.45" if high else "0.2",
                "Profit": "-20.25" if high else "30.125",
            }
        )
    return lines


def write(folder, content, name="feed.csv", encoding="utf-8-sig"):
    path = folder / name
    path.write_bytes(content.encode(encoding))
    return str(path)
