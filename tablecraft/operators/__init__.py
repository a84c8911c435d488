"""Operations from DataFrames to DataFrames."""
