"""terrane.streaming"""
