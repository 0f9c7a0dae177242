"""Training-data operators over document and conversation tables.

Nothing outside this package imports it.  Every operator takes and returns
DataFrames, names its input columns by parameters, and keeps decisions on
narrow columns (identifiers, digests, lengths) so that long texts are shuffled
only where bytes have to be compared.
"""
