"""Operations of a training-data pipeline: scores, filters, joins, encodings and packing. Nothing outside imports this."""
