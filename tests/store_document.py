"""A document of the shape that path languages are often shown with; the values are made up."""

STORE = (
    '{"store":{"book":[{"category":"reference","author":"A. One","title":"First","price":8.95},{"category":"fiction","author":"B. Two","title":"Second","price":12.99},'
    '{"category":"fiction","author":"C. Three","title":"Third","isbn":"0-000-00000-1","price":8.99},{"category":"fiction","author":"D. Four","title":"Fourth","isbn":"0-000-00000-2","price":22.99}],'
    '"bicycle":{"color":"red","price":19.95}}}'
)
