"""Training-data operators over text collections; `registry` lists their queries."""
