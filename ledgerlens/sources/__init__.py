"""Reading, typing, landing and publishing order lines; writing and re-reading reports."""
