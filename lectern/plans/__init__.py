"""Registered queries over the driver's tables."""

from lectern.plans import catalog, keeping, library, media, records, shelf, stored, text


def queries():
    return {**catalog.QUERIES, **library.QUERIES, **text.QUERIES, **media.QUERIES, **records.QUERIES, **shelf.QUERIES, **stored.QUERIES, **keeping.QUERIES}


def oracle_sql():
    return {**catalog.ORACLES, **library.ORACLES, **text.ORACLES, **media.ORACLES, **records.ORACLES, **shelf.ORACLES, **stored.ORACLES, **keeping.ORACLES}
