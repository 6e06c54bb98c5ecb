"""A search service of two granules a page, for the data source's test."""


def page(n: int):
    return [(f"g{n}{i}", "P", "2024-01-01", None, None) for i in range(2)]
