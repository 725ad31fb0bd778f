"""Graph and relational operators; every public function takes and returns DataFrames."""
