"""orderlens.operators"""
