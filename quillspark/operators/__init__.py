"""One function per operator, DataFrame to DataFrame. Order is always explicit: rows have none of their own."""
