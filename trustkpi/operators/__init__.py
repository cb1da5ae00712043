"""DataFrame operators. ``keys`` names the columns that tell datasets apart;
with no keys the whole input is one dataset."""
