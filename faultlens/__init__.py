"""Spark DataFrame operators that turn issue reports into ranked fault labels."""
