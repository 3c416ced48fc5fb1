"""Sources: parameter, scene and palette files, catalogues, and binary snapshots as DataFrames."""
