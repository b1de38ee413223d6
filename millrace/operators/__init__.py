"""DataFrame operators of the engine: joins, aggregation, windows, order and sets, writes."""
